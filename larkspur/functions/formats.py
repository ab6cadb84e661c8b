"""Names of formats; no Spark."""

#: What the name of a numeric format says about the kind of its values, tried in this order.
#: kind, texts anywhere in the name, beginnings, ends.
FORMAT_KINDS = (
    ("datetime", ("DATETIME",), ("DT", "E8601DT", "B8601DT"), ("DT",)),
    ("time", ("TIME",), ("E8601TM", "HHMM"), ("TM",)),
    ("date", ("DATE", "YY", "MON", "WEEK", "YEAR", "MINGUO"), ("E8601DA", "B8601DA"), ("DA",)),
)
