"""Shared cases."""

def sql_rows(sf, sql):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con.sql(sql).df()


#: Nulls, empty and long texts, copies, control characters, special tokens, a repeated and a missing id.
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "The cat sat on the mat. " * 40), (6, "The cat sat on the mat. " * 40), (7, "the cat sat on the MAT. " * 40), (8, "Ünïcödé 日本語 😀 ñandú\r\nЖук"), (9, "x" * 30_000), (10, "word " * 20_000), (11, "<|endoftext|> a <|startoftext|>"), (12, "\x1c\x85 a  b"), (5, "repeated id"), (None, "no id")]
