import duckdb
from pyspark.sql import functions as F

from termloom.llm import quotes
from termloom.llm.registry import queries

ROWS = [
    (1, 0, "user", "Hello there.\nHow  does it WORK?"),
    (1, 1, "assistant", "> how does it work?\nIt works by magic.\n\nSecond paragraph\nof two lines."),
    (1, 2, "user", ">> How does it work?\n> It works by magic.\n\nReally?"),
    (1, 3, "user", "> second paragraph\n>  of two lines.\n\n> not said by anyone\nI see."),
    (1, 4, "user", "> really?\n> \n> I see.\nok"),
    (1, 5, "user", "Hello there.\nHow does it work?"),
    (1, 6, "user", "  > HELLO THERE. how does it work?\nagain"),
    (1, 7, "user", "> again\n"),
    (2, 0, "user", "> how does it work?\nelsewhere"),
    (2, 1, "user", None),
    (2, 2, "user", ""),
    (2, 2, "user", "elsewhere"),
    (2, 3, "user", "a > b is no quote"),
    (2, 4, "user", "> a > b is no quote\n> elsewhere"),
    (2, 4, "user", "> a > b is no quote\n> elsewhere"),
    (None, 5, "user", "> elsewhere"),
    (3, None, "user", "> x\ny"),
    (3, 1, "user", "y"),
    (5, 0, "user", "l1\nl2\nl3\n\nl5"),
    (5, 1, "user", "> l1\n> l2\ntrimmed at the end"),
    (5, 2, "user", "> L2\n>  l3\ntrimmed in front"),
    (5, 3, "user", "> l1\n> l3\nnot neighbours"),
    (5, 4, "user", "l2\nl3\nl4"),
    (5, 5, "user", "> l1\n> l2\n> l3\n> l4\nfrom two messages"),
    (5, 6, "user", "> l2\n> l3\nthe later of two"),
    (5, 7, "user", ">> nobody said this\n> trimmed at the end\n>> l3\n>> l4\nlevels"),
    (4, 0, "user", "ok\n" * 3000),
    (4, 1, "user", "> ok\n" * 3000),
]


def test_links_and_threads(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.link_conversations(df).collect()}
    parent = {k: r.parent_turn for k, r in got.items() if k[0] == 1}
    assert parent == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 2, (1, 5): None, (1, 6): 5, (1, 7): 6}
    assert [(got[1, t].thread_turn, got[1, t].depth) for t in range(8)] == [(0, 0), (0, 1), (0, 2), (0, 2), (0, 3), (5, 0), (5, 1), (5, 2)]
    assert (got[1, 2].n_quotes, got[1, 2].n_linked, got[1, 2].text) == (2, 2, "\nReally?")
    assert (got[1, 3].n_quotes, got[1, 3].n_linked) == (2, 1)
    assert got[2, 0].parent_turn is None and got[2, 4].parent_turn is None
    assert len(quotes.link_conversations(df).collect()) == len(ROWS)
    order = [(r.conv_id, r.thread_turn, r.turn) for r in quotes.in_reply_order(quotes.link_conversations(df.where("conv_id = 1"))).collect()]
    assert order == sorted(order)


def test_trimmed_quotes_and_unknown_levels(spark):
    df = spark.createDataFrame([(*r, 7, "x") for r in ROWS if r[0] == 5], "conv_id long, turn long, role string, text string, level int, key string")
    got = {r.turn: (r.n_quotes, r.n_linked, r.parent_turn) for r in quotes.link_conversations(df).collect()}
    assert got == {0: (0, 0, None), 1: (1, 1, 0), 2: (1, 1, 0), 3: (1, 0, None), 4: (0, 0, None), 5: (1, 0, None), 6: (1, 1, 4), 7: (3, 2, 1)}


def test_sql_twin_on_quotes(spark, tmp_path):
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{path}/*.parquet')")
    names = ["conv_id", "turn", "role", "n_quotes", "n_linked", "parent_turn", "thread_turn", "depth", "own_sha256"]
    want = sorted(map(str, con.sql(f"select {', '.join(names)} from ({quotes.OP8_SQL})").fetchall()))
    got = sorted(str(tuple(r[n] for n in names)) for r in queries()["op8_quote_links"](spark, str(tmp_path)).collect())
    assert got == want


def test_long_chain_and_empty(spark):
    rows = [(1, t, "user", (f"> line {t - 1}\n" if t else "") + f"line {t}") for t in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.parent_turn, r.thread_turn, r.depth) for r in quotes.link_conversations(df).collect()}
    assert got == {t: (t - 1 if t else None, 0, t) for t in range(70)}
    assert quotes.link_conversations(df.where(F.lit(False))).count() == 0
