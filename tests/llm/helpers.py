"""Small documents with every odd case, for all operators."""

import zlib

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def odd_documents():
    """Nulls in each column, empty and blank texts, a very long one, ties and repeated rows."""
    base = "Alpha beta gamma delta epsilon zeta eta theta iota kappa. Lambda mu nu xi omicron pi rho sigma tau upsilon."
    rows = [
        (0, base, "en", "b", 10),
        (1, base, "en", "b", 10),
        (2, base + " Phi.", "en", "a", None),
        (3, None, "en", "a", 0),
        (4, "", None, "a", 0),
        (5, " \t\n ", "de", None, 3),
        (6, "12 34 !!", "de", None, 8),
        (7, "ÄÖÜ straße Füße und größer über die Brücke", "de", "c", 40),
        (8, "word " * 20000, "en", "c", 100000),
        (9, "x" * 30000, "en", "c", 30000),
        (None, "no id here at all", "en", "c", 17),
        (None, None, None, None, None),
        (10, "one", "en", "B", 3),
        (10, "one", "en", "B", 3),
        (10, "two words", "en", "B", 9),
    ]
    return rows + [(100 + i, f"The {w} sentence number {i} is here with the other words of it. And {w} more.", "en" if i % 2 else "fr", f"s{i % 4}", 60) for i, w in enumerate(["red", "blue", "green", "white", "black", "grey"] * 6)]


def with_clashing_columns(frame):
    """Extra columns under names that operators use inside."""
    from pyspark.sql import functions as F

    for name in ("row", "size", "target", "score", "word", "fp", "hash", "key", "text_key", "rank", "part", "ids", "label", "draw", "rate", "copies", "_size", "block", "__id", "__key", "__size", "__rows", "__text_key", "c0", "c1", "c7", "item_id", "n", "copy"):
        frame = frame.withColumn(name, F.lit("clash"))
    odd = F.struct(F.lit(1).alias("my-key"), F.create_map(F.lit("k"), F.array(F.struct(F.lit("x").alias("a b")))).alias("`map`"))
    return frame.withColumn("meta data", odd).withColumn("a.map", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("list", F.array(F.lit(1.5), F.lit(None)))
