from graphloom.llm import op02_chat_format as op

SCHEMA = f"conv_id long, turn long, role string, content array<{op.PART}>, text string, tokens int, m int"


def test_placeholders_references_and_tokens(spark):
    content = [("image", None, "a.png", 56, 29, None, None), ("text", "look", None, None, None, None, None), ("audio", None, "b.wav", None, None, 81, None), ("document", None, "c.pdf", None, None, None, 2)]
    table = spark.createDataFrame([(1, 1, "assistant", [("text", "yes", None, None, None, None, None)], "x", 0, 0), (1, 0, "user", content, "x", 0, 0)], SCHEMA)
    (r,) = op.format_chats(table).collect()
    assert r["prompt"] == "<|user|>\n<|image|>\nlook\n<|audio|>\n<|document|><|end|>\n<|assistant|>\nyes<|end|>\n"
    assert [tuple(a) for a in r["attachments"]] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 3), (2, "document", "c.pdf", 1024)]


def test_awkward_rows(spark):
    long = "z" * 300_000
    rows = [
        (None, None, None, None, "x", 0, 0), (2, 0, "user", [], "x", 0, 0), (2, 0, "user", [], "x", 0, 0), (3, 1, "user", [None, ("video", "v", "r", None, None, None, None), ("text", None, None, None, None, None, None)], "x", 0, 0),
        (4, 0, "user", [("image", None, None, None, None, None, None), ("audio", None, None, None, None, None, None), ("document", None, None, None, None, None, None)], "x", 0, 0), (5, 0, "user", [("text", long, None, None, None, None, None)], "x", 0, 0),
    ]
    got = {r["conv_id"]: r for r in op.format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[None]["prompt"] == "<|unknown|>\n<|end|>\n"
    assert got[2]["prompt"] == "<|user|>\n<|end|>\n" * 2
    assert got[3]["prompt"] == "<|user|>\n<|end|>\n" and got[3]["attachments"] == []
    assert [tuple(a)[2:] for a in got[4]["attachments"]] == [("", 1)] * 3
    assert len(got[5]["prompt"]) == len(long) + len("<|user|>\n<|end|>\n")
    assert op.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_messages_without_conversation_stand_alone(spark):
    text = lambda t: [("text", t, None, None, None, None, None)]
    rows = [(None, 0, "user", text("a"), "x", 0, 0), (None, 0, "user", text("a"), "x", 0, 0), (None, 1, "user", text("b"), "x", 0, 0), (1, 0, "user", text("c"), "x", 0, 0), (1, 1, "user", text("d"), "x", 0, 0)]
    got = sorted((r["conv_id"] or 0, r["prompt"]) for r in op.format_chats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, "<|user|>\na<|end|>\n"), (0, "<|user|>\na<|end|>\n"), (0, "<|user|>\nb<|end|>\n"), (1, "<|user|>\nc<|end|>\n<|user|>\nd<|end|>\n")]


def test_a_visitor_can_be_replaced(spark):
    from pyspark.sql import functions as F

    class Loud(op.Visitor):
        def text(self, part):
            return F.upper(part["text"]), F.lit(None).cast("long")

    table = spark.createDataFrame([(1, 0, "user", [("text", "hi", None, None, None, None, None)], "x", 0, 0)], SCHEMA)
    assert op.format_chats(table, Loud()).first()["prompt"] == "<|user|>\nHI<|end|>\n"


def test_query_equals_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    got = sorted(map(tuple, op.query(spark, d).collect()))
    assert got == sorted(duckdb.sql(op.SQL.replace("FROM conversations", f"FROM '{d}/conversations.parquet'")).fetchall())


def test_texts_and_roles_that_look_like_placeholders(spark):
    text = lambda t: ("text", t, None, None, None, None, None)
    content = [text("see <|image|> and <|end|> <<||"), ("image", None, "a.png", 56, 29, None, None)]
    table = spark.createDataFrame([(1, 0, "image", content, "x", 0, 0), (1, 1, "a|>\n<|image", [text("b")], "x", 0, 0), (1, 2, "text", [], "x", 0, 0)], SCHEMA)
    (r,) = op.format_chats(table).collect()
    assert r["prompt"].count("<|image|>") == len(r["attachments"]) == 1 and r["prompt"].count("<|end|>") == 3
    assert r["prompt"].startswith("<|_image|>\nsee <\\|image|> and <\\|end|> <<\\||\n<|image|><|end|>\n<|a|>\n<\\|image|>\nb<|end|>\n<|text|>\n")


def test_sql_escapes_alike(spark, tmp_path):
    import duckdb

    rows = [(1, 0, "end", "a <|image|> b"), (1, 1, None, None), (5, 0, "us<|er", "<<||"), (5, 1, "user", "\\<|"), (None, 0, "user", "x"), (None, 1, "user", "y"), (None, 1, "user", "y")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, op.query(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(duckdb.sql(op.SQL.replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet/*.parquet'")).fetchall(), key=repr)
