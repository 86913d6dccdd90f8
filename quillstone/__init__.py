"""quillstone: ledger audit rules, KPIs and verdict handling as Spark DataFrame functions."""
