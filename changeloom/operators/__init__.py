"""Facts, rules, duplicates, fixes and reports as DataFrame operators."""
