"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A batch of changes holds a document's state before and after (either may be missing: an insert, a delete, a revision). What it adds to each
total is the counts of the after side less those of the before side, so totals are additive and a batch costs its own size. A batch
is committed once: its deltas are written to a folder of their own, and then a marker that names the folder appears, written in full under another name
and renamed, which fails if the batch has one. A batch that is sent again, or whose job was run twice, changes nothing, and the folder of a lost attempt
is never read. Every COMPACT batches the totals are rolled up into a snapshot, so a read adds the batches since then to it.

Renaming without overwriting is atomic on HDFS. On a store that has no such rename, one writer at a time has to commit.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.llm import kernels as K
from changeloom.llm.common import bounded_batches

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
#: Version name of a tokenizer and the file of its ranks; utf8_bytes needs none.
TOKENIZERS = {"byte_bpe_50k": "/opt/tokenizers/byte_bpe_50k.tiktoken", "utf8_bytes": ""}
CHUNK = 8 << 20
#: Batches after which the totals are rolled up into a snapshot.
COMPACT = 32
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Counter:
    """Counts the tokens of a batch of texts by a byte-pair encoding given as ranks.

    The pattern always starts a new piece at a single space between two visible characters, so a text's count is
    the sum over its parts between such spaces, and each distinct part of a batch is encoded once.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.zeros(len(off) - 1, np.int64)
        for lo, hi in K.slices(off, CHUNK):
            part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            if not len(part):
                continue
            seen = (part > 32) & (part != 127)
            after = seen & ~np.isin(part, np.array([0xC2, 0xE1, 0xE2, 0xE3], np.uint8))
            split = np.zeros(len(part), bool)
            split[1:-1] = (part[1:-1] == 32) & seen[:-2] & after[2:]
            # A space that is the first byte of its row, or whose next byte is another row's, isn't between two characters of the row.
            at = o[(o > 0) & (o < len(part))]
            split[at] = False
            split[at - 1] = False
            r = K.Runs(part, o, cls=(~split).astype(np.uint8))
            first = np.ones(len(r.row), bool)
            first[1:] = r.row[1:] != r.row[:-1]
            key = np.where(first, r.hash, K.mix(r.hash ^ K.U64(0xABCD)))  # with the space before it, or without
            _, where, which = np.unique(key, return_index=True, return_inverse=True)
            raw = part.tobytes()
            begin = r.start[where] - ~first[where]
            counts = np.fromiter((len(self.encode(raw[a:b].decode())) for a, b in zip(begin.tolist(), r.end[where].tolist(), strict=True)), np.int64, len(where))
            out[lo:hi] = np.bincount(r.row, weights=counts[which], minlength=hi - lo).astype(np.int64)
        return out


SIDE = "struct<source:string,lang:string,counts:array<struct<tokenizer:string,tokens:bigint>>>"


def count_tokens(docs: DataFrame, tokenizers: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, side) for each document: its source, its language, and its tokens by tokenizer version. A map over whole texts.

    A null or empty text has no tokens. Null sources and languages stay null. Repeated rows are counted each. Other columns are ignored.
    """
    bounded_batches(docs)
    names = TOKENIZERS if tokenizers is None else tokenizers

    @K.lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [Counter(p) if p else None for p in names.values()]
        for b in it:
            data, off = K.text_of(b.column(3))
            counts = [c(data, off) if c else np.diff(off) for c in counters]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *map(pa.array, counts)], names=["doc_id", "source", "lang", *(f"n{i}" for i in range(len(names)))])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col(text_col).cast("string").alias("text"))
    counted = src.mapInArrow(run, "doc_id long, source string, lang string, " + ", ".join(f"n{i} long" for i in range(len(names))))
    each = F.array(*(F.struct(F.lit(n).alias("tokenizer"), F.col(f"n{i}").alias("tokens")) for i, n in enumerate(names)))
    return counted.select("doc_id", F.struct("source", "lang", each.alias("counts")).alias("side"))


def inserts(counted: DataFrame) -> DataFrame:
    return counted.select(F.lit(None).cast(SIDE).alias("before"), F.col("side").alias("after"))


def deletes(counted: DataFrame) -> DataFrame:
    return counted.select(F.col("side").alias("before"), F.lit(None).cast(SIDE).alias("after"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes of the documents that are on both sides, by doc_id; only counts are joined, never texts."""
    return before.select("doc_id", F.col("side").alias("before")).join(after.select("doc_id", F.col("side").alias("after")), "doc_id").select("before", "after")


def deltas(changes: DataFrame) -> DataFrame:
    """What a batch adds to each total: (source, lang, tokenizer, docs, tokens), signed.

    changes: sides before and after as in `count_tokens`, null where the document isn't there. Null sources and languages are keys of their
    own. A change with neither side adds nothing; repeated changes count each time.
    """
    sides = F.array(F.struct(F.lit(1).cast("long").alias("sign"), F.col("after").alias("s")), F.struct(F.lit(-1).cast("long").alias("sign"), F.col("before").alias("s")))
    one = changes.select(F.explode(sides).alias("x")).where("x.s is not null").select("x.sign", "x.s.source", "x.s.lang", F.explode("x.s.counts").alias("c"))
    return one.groupBy("source", "lang", F.col("c.tokenizer").alias("tokenizer")).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("c.tokens")).alias("tokens"))


class Ledger:
    """Committed deltas under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda *p: jvm.org.apache.hadoop.fs.Path("/".join((self.path, *p)))
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, what: str) -> list[str]:
        """Names in a folder, without those that are still being written."""
        where = self._path(what)
        return sorted(n for s in self._fs.listStatus(where) if not (n := s.getPath().getName()).startswith((".", "_"))) if self._fs.exists(where) else []

    def _read(self, *p: str) -> list[str]:
        with_ = self._fs.open(self._path(*p))
        try:
            raw = bytes(with_.readAllBytes())
        finally:
            with_.close()
        return raw.decode().split("\n")

    def _appear(self, lines: list[str], *p: str) -> bool:
        """Writes a file in full under another name, and gives it its own unless that is taken; says whether it did."""
        own = (*p[:-1], f".{p[-1]}.{uuid.uuid4().hex}")
        out = self._fs.create(self._path(*own), False)
        out.write("\n".join(lines).encode())
        out.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(*own), self._path(*p), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception as e:
            self._fs.delete(self._path(*own), False)
            if self._fs.exists(self._path(*p)):  # another writer was first
                return False
            raise e
        return True

    def committed(self) -> set[str]:
        """The batches that count."""
        return {bytes.fromhex(n).decode() for n in self._list("commits")}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds the batch unless it was added before; says whether it did."""
        name = batch.encode().hex() or "00"
        if name in self._list("commits"):
            return False
        folder = f"deltas/{uuid.uuid4().hex}"
        deltas(changes).write.parquet(f"{self.path}/{folder}")
        if not self._appear([folder], "commits", name):
            return False
        if len(self._since()[1]) >= COMPACT:
            self.compact()
        return True

    def _since(self) -> tuple[str | None, list[str], set[str]]:
        """Folder of the snapshot that covers most batches, the names of the batches that it doesn't cover, and of those that it does."""
        every = self._list("commits")
        last = self._list("snapshots")
        if not last:
            return None, every, set()
        folder, *covered = self._read("snapshots", last[-1])
        return folder, [n for n in every if n not in set(covered)], set(covered)

    def _rows(self, folder: str | None, names: list[str]) -> DataFrame:
        folders = [*([folder] if folder else []), *(self._read("commits", n)[0] for n in names)]
        if not folders:
            return self.spark.createDataFrame([], DELTA)
        rows = self.spark.read.schema(DELTA).parquet(*(f"{self.path}/{f}" for f in folders))
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 or tokens != 0")

    def compact(self) -> None:
        """Rolls all batches up into a snapshot. Batches that are committed meanwhile stay outside it; a lost attempt leaves the snapshot before."""
        folder, names, covered = self._since()
        if not names:
            return
        out = f"totals/{uuid.uuid4().hex}"
        self._rows(folder, names).coalesce(1).write.parquet(f"{self.path}/{out}")
        both = sorted(covered | set(names))
        self._appear([out, *both], "snapshots", f"{len(both):012d}")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all committed batches, without the keys that are back at 0."""
        folder, names, _ = self._since()
        return self._rows(folder, names)
