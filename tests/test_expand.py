"""Run x question expansion and what follows it: no (run, question) row is shuffled or stored."""

from pyspark.sql import functions as F

from groundeval.operators import generate as GN
from groundeval.operators import grid as G

GRID = "config_id long, num_examples long, dataset_name string"
QA = "dataset_name string, id string, ordinal long"


def _tables(spark):
    takes = [None, 0, -3, 1, G.QUESTION_BLOCK, G.QUESTION_BLOCK + 1, 10**7]
    grid = [(i, n, d) for i, (n, d) in enumerate((n, d) for n in takes for d in ("a", "b", "c", None))] + [(1, 5, "a")] * 2
    qa = [(d, f"{d}{i}", i) for d, n in (("a", 3 * G.QUESTION_BLOCK + 7), ("b", 2)) for i in range(n)] + [(None, "x", 0), ("b", "y", None), ("b", "z", -1)]
    return grid, qa, spark.createDataFrame(grid, GRID), spark.createDataFrame(qa, QA)


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line]


def test_runs_meet_the_first_questions_of_their_dataset(spark):
    grid, qa, g, q = _tables(spark)
    size = {d: sum(x[0] == d for x in qa) for d in ("a", "b")}
    want = sorted((d, o, c, n or 0, i) for c, n, d in grid if d in size for e, i, o in qa
                  if e == d and o is not None and 0 <= o < (size[d] if n is None else min(n, size[d])))
    got = G.run_expand(g, q)
    assert got.columns == ["dataset_name", "ordinal", "config_id", "num_examples", "id"]
    assert sorted((r.dataset_name, r.ordinal, r.config_id, r.num_examples or 0, r.id) for r in got.collect()) == want


def test_runs_are_dealt_by_blocks_not_by_questions(spark):
    _, qa, g, q = _tables(spark)
    n = sum(x[0] == "a" for x in qa)
    rows = G.run_blocks(g.where("num_examples > 1000 AND dataset_name = 'a'"), q).collect()
    assert [(r._block, r._take) for r in sorted(rows, key=lambda r: r._block)] == [(b, n) for b in range(-(-n // G.QUESTION_BLOCK))]


def test_dealt_prompts_are_answered_where_they_are(spark):
    df = spark.range(10).select("id", F.concat(F.lit("p "), F.col("id")).alias("prompt"), F.lit("why ANSWER").alias("prompt_2"))
    echo = lambda: GN.EchoPredictor(1)
    two = [GN.generate_two_step(df, echo, spread=s) for s in (True, False)]
    assert [len(_exchanges(x)) for x in two] == [1, 0]
    assert sorted(map(tuple, two[0].collect())) == sorted(map(tuple, two[1].collect()))
    one = [sorted(map(tuple, GN.generate(df, echo, spread=s).collect())) for s in (True, False)]
    assert one[0] == one[1]


def test_aligned_predictions_store_no_run_question_rows(spark, monkeypatch):
    from groundeval import session
    from groundeval.plans.catalog import load_all

    def refuse(*a, **k):
        raise AssertionError("(run, question) rows are stored")

    monkeypatch.setattr(session, "cut_lineage", refuse)
    assert load_all()["align_predictions"].build(spark, "/root/testdata/sf0.001").columns == ["run_id", "idx", "id", "pred", "status"]


def test_a_run_travels_by_the_root_of_the_pairs(spark):
    """Blocks widen with the dataset, and a question goes to the buckets that ask it, so neither side
    travels as often as the other has rows."""
    size = 50 * G.QUESTION_BLOCK
    q = spark.range(size).select(F.lit("a").alias("dataset_name"), F.col("id").cast("string").alias("id"), F.col("id").alias("ordinal"))
    g = spark.range(40).select(F.col("id").alias("config_id"), F.lit(10**7).cast("long").alias("num_examples"), F.lit("a").alias("dataset_name"))
    assert G.run_blocks(g, q).count() <= 40 * G._cuts(int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = G.run_expand(g, q, tiles=True)
    assert both.count() == both.select("config_id", "id").distinct().count() == 40 * size
    assert both.groupBy("config_id").agg(F.countDistinct("_bucket").alias("n")).where("n > 1").count() == 0


def test_runs_of_one_id_share_their_tiles(spark):
    _, _, g, q = _tables(spark)
    twice = g.where("dataset_name = 'a'").withColumn("num_examples", F.lit(9).cast("long"))
    found = G.run_expand(twice.unionByName(g.where("dataset_name = 'a'")), q, run_cols=["config_id"], tiles=True)
    assert found.groupBy("config_id", "ordinal").agg(F.countDistinct(*G.TILE).alias("n")).where("n > 1").count() == 0


def test_more_pairs_more_tasks(spark, monkeypatch):
    _, _, g, q = _tables(spark)
    few = G.pair_tasks(g, q)
    pairs = G.run_expand(g, q).count()
    monkeypatch.setattr(G, "PAIRS", 10)
    assert few == int(spark.conf.get("spark.sql.shuffle.partitions")) and 0 <= G.pair_tasks(g, q) - pairs / 10 < 5
    assert G.pair_tasks(g.where("num_examples = 0"), q) == 0


PARTS = [None, "", " ", "\n\t", "ab ", " \x0bab", " ab ", "é? "]


def _prompt_tables(spark):
    ends = [(b, a) for b in PARTS for a in PARTS]
    grid = [(i, None, ds, m, b, a) for ds in ("eli5_x", "nq_y") for m in ("gpt3", "t5") for i, (b, a) in enumerate(ends)]
    qa = [(ds, f"{i}", i, t) for ds in ("eli5_x", "nq_y") for i, t in enumerate(["wHo is É", " ", "", "\tßa B\n", None])]
    return (spark.createDataFrame(grid, GRID + ", model_name string, prompt_before string, prompt_after string"),
            spark.createDataFrame(qa, QA + ", title string"))


def test_parts_of_prompts_are_made_before_runs_meet_questions(spark):
    g, q = _prompt_tables(spark)
    runs, asked = G.prepare_prompts(g, q)
    made, plain = G.render_prompts(G.run_expand(runs, asked)), G.render_prompts(G.run_expand(g, q))
    assert sorted(made.columns) == sorted(plain.columns)
    rows = [sorted((tuple(r) for r in x.select(sorted(x.columns)).collect()), key=repr) for x in (made, plain)]
    assert rows[0] == rows[1] and len(rows[0]) == 5 * 4 * len(PARTS) ** 2
    for r in made.collect():
        if r.mode == "single":
            cap = r.title and r.title[:1].upper() + r.title[1:].lower()
            want = None if r.title is None else ((r.prompt_before or "") + cap + (r.prompt_after or "")).strip(" \t\n\r\f\x0b")
            assert (r.prompt, r.prompt_2) == (want, None)
    above = made.select("prompt")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "lower(" not in above and "upper(" not in above


def test_both_steps_are_answered_in_one_python_stage(spark):
    rows = [("p one", "why ANSWER, ANSWER"), ("", "x"), ("p  two x", "why ANSWER, ANSWER"), (None, "why ANSWER"), ("a b", None), ("　a\x1cb c", ""), ("aa", "ANSWER")]
    df = spark.createDataFrame(rows, "prompt string, prompt_2 string").withColumn("run_id", F.lit(3)).coalesce(1)
    got = GN.generate_two_step(df, lambda: GN.EchoPredictor(2), batch_size=2, spread=False, cols=["run_id"])
    assert got.columns == ["run_id", "pred"]
    assert str(got._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1
    echo = lambda p: GN.EchoPredictor(2)([p])[0]
    clear = lambda g, p: (g.replace(p, "") if p else g).strip(" \t\n\r\f\x0b")

    def plain(p, p2):
        if p is None or p2 is None:
            return None
        filled = p2.replace("ANSWER", clear(echo(p), p))
        return f"{clear(echo(p), p)};{clear(echo(filled), filled)}"

    assert [r.pred for r in got.collect()] == [plain(*r) for r in rows]


def test_echo_takes_words_between_ascii_white_space(spark):
    rows = ["a b c d", " a\x0bb\n\nc ", "a\x1cb c\x85d e\xa0f g", "", " ", "x", "a b c d"]
    plain = [f"{p} {' '.join([w for w in GN._WS.split(p) if w][:3])}" for p in rows]
    assert GN.EchoPredictor(3)(rows) == plain == [GN.EchoPredictor(3)([p])[0] for p in rows]


def test_tiles_are_aligned_as_the_whole(spark):
    q = [(r, i, f"q{r}{i}{c}") for r in (1, 2, None) for i in (0, 1, None) for c in "ab"] + [(7, 0, None)]
    p = [(r, i, f"p{r}{i}{c}") for r in (2, 3, None) for i in (1, 2, None) for c in "cd"] + [(8, 1, None)]
    q, p = spark.createDataFrame(q, "run_id long, idx long, id string"), spark.createDataFrame(p, "run_id long, idx long, pred string")
    tile = [(F.col("run_id") % 2).alias("_bucket"), F.floor(F.col("idx") / 2).alias("_block")]
    got = G.align_predictions(q.select("*", *tile), p.select("*", *tile), within=G.TILE)
    want = G.align_predictions(q, p)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_run_question_rows_are_aligned_without_a_shuffle(spark):
    from groundeval.plans.catalog import load_all

    found = load_all()["align_predictions"].build(spark, "/root/testdata/sf0.001")
    assert not [x for x in _exchanges(found) if ("idx" in x or "ordinal" in x) and "extra" not in x]


def test_runs_that_share_an_id_are_aligned_across_datasets(spark, tmp_path):
    import duckdb

    from groundeval.plans.catalog import load_all

    d = str(tmp_path)
    supplier = [(k, f"S{k}", n, 1.0) for k, n in ((1, 0), (1, 1), (2, 2), (2, 2), (5, 3), (5, 0), (None, 1), (None, 2), (6, 7))]
    talk = [(c, t, role, f"text {c} {t}") for c in range(20) for t, role in enumerate(("user", "assistant", "user", "assistant"))]
    tables = {"supplier": (supplier, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
              "nation": ([(i, f"N{i}", i % 5) for i in range(10)], "n_nationkey int, n_name string, n_regionkey int"),
              "conversations": (talk, "conv_id long, turn int, role string, text string")}
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{d}/{name}.parquet/*.parquet')")
    query = load_all()["align_predictions"]
    got = [tuple(r) for r in query.build(spark, d).where("run_id is not null").collect()]
    want = [r for r in con.execute(query.sql).fetchall() if r[0] is not None]  # the SQL names a null run's status by its null
    assert len(got) > 200 and sorted(got, key=repr) == sorted(want, key=repr)
