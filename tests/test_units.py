"""Unit tables for the scalar/array operators (edge cases are part of the contract)."""

from pyspark.sql import functions as F

from groundeval.functions import answers as A
from groundeval.functions import prompts as P
from groundeval.functions.bleu import bleu_tokens
from groundeval.functions.lcs import lcs_length, lcs_python
from groundeval.functions.text import capitalize, char_ngrams, normalized_tokens, strip
from groundeval.operators import metrics as M
from groundeval.operators import popularity as PO


def _one(spark, rows, expr, schema="x string"):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr).collect()]


def test_semicolon_parse(spark):
    a, e = A.parse_semicolon("x")
    got = _one(spark, [("a;b;c",), ("abc",), ("a; b ",)], F.struct(a, e))
    assert [tuple(r) for r in got] == [("a", "b"), ("abc", "abc"), ("a", "b")]


def test_choice_parse(spark):
    a, e = A.parse_choice("x")
    got = _one(spark, [("b) x;y",), ("",)], F.struct(a, e))
    assert [tuple(r) for r in got] == [("B", "y"), ("", "")]


def test_newline_parse(spark):
    a, e = A.parse_newline("x")
    got = _one(spark, [("Answer: X\nExplanation: Y",)], F.struct(a, e))
    assert tuple(got[0]) == (" x", ": y")


def test_json_parse(spark):
    a, e = A.parse_json("x")
    got = _one(spark, [("{'answer': 'x', 'explanation': 'y'}",), ("junk",), ('{"answer": "only"}',)], F.struct(a, e))
    assert [tuple(r) for r in got] == [("x", "y"), ("junk", "junk"), ('{"answer": "only"}', '{"answer": "only"}')]


def _quotes_scanner(s):
    out, cur, buf = [], None, []
    for ch in s:
        if ch in "\"'":
            if cur is None:
                cur = ch
            elif cur == ch:
                out.append("".join(buf))
                cur, buf = None, []
            else:
                buf.append(ch)
        elif cur is not None:
            buf.append(ch)
    return "<SEP>".join(out)


def test_quotes_cases_and_scanner(spark):
    import random

    cases = ["say \"a 'b' c\" and 'd'", "it's \"x", '""', "no quotes", "a'b\"c'd\"e"]
    rnd = random.Random(7)
    for _ in range(300):
        cases.append("".join(rnd.choice("ab \"'\n") for _ in range(rnd.randint(0, 12))))
    got = _one(spark, [(c,) for c in cases], A.extract_quotes("x"))
    assert got[:3] == ["a 'b' c<SEP>d", "", ""]
    assert got == [_quotes_scanner(c) for c in cases]


def test_capitalize_and_strip(spark):
    assert _one(spark, [("wHo is BOB",)], capitalize("x")) == ["Who is bob"]
    assert _one(spark, [("\n\t a b \n",)], strip("x")) == ["a b"]


def test_bins_presets(spark):
    vals = [0, 1, 2, 10, 11, 10000, 10001]
    df = spark.createDataFrame([(v,) for v in vals], "p long")
    s = [r[0] for r in df.select(PO.bin_label("p", PO.SAMPLING_BINS)).collect()]
    p = [r[0] for r in df.select(PO.bin_label("p", PO.PLOTTING_BINS)).collect()]
    assert s == ["(-1, 0]", None, "(1, 10]", "(1, 10]", "(10, 100]", "(1000, 10000]", None]
    assert p == ["(-1, 0]", "(0, 10]", "(0, 10]", "(0, 10]", "(10, 100]", "(1000, 10000]", None]


def test_grams_width_two_code_points(spark):
    got = _one(spark, [("a\U0001F600bc",), ("a",)], char_ngrams("x", 2))
    assert got == [["a\U0001F600", "\U0001F600b", "bc"], []]


def test_refs_coercion(spark):
    df = spark.createDataFrame([([None],), ([],), (["x"],), (None,)], "r array<string>")
    got = [r[0] for r in df.select(A.coerce_refs("r")).collect()]
    assert got == [["empty ref"], ["empty ref"], ["x"], ["empty ref"]]


def test_normalizer_and_em_f1(spark):
    assert _one(spark, [("The  Cat, a dog!",)], normalized_tokens("x")) == [["cat", "dog"]]
    df = spark.createDataFrame([("the cat sat", "a cat sat down"), ("x", "y"), ("", "")], "p string, g string")
    rows = df.select(M.exact_match("p", "g"), M.token_f1("p", "g"), M.token_f1("g", "p")).collect()
    assert rows[0][0] == 0.0 and abs(rows[0][1] - 2 * 2 / (2 + 3)) < 1e-12 and rows[0][1] == rows[0][2]
    assert rows[1][1] == 0.0 and rows[2][1] == 0.0


def test_lcs_native_equals_bitparallel(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for _ in range(200):
        a = [rnd.choice("abcde") for _ in range(rnd.randint(0, 30))]
        b = [rnd.choice("abcde") for _ in range(rnd.randint(0, 30))]
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = [r[0] for r in df.select(lcs_length(F.col("a"), F.col("b"))).collect()]
    assert got == [lcs_python(a, b) for a, b in rows]


def test_bleu_tokenizer_13a(spark):
    got = _one(spark, [("Hello, World! It's 3.5-4 (approx).",)], bleu_tokens(F.col("x")))
    assert got == [["hello", ",", "world", "!", "it's", "3.5", "-", "4", "(", "approx", ")", "."]]


def test_prompt_insertion_rules(spark):
    rows = [("B", "A", "p", "before", "before"), ("B", "A", "p", "before", "after"),
            ("B", "A", "p", "after", "after"), ("B", "A", "p", "after", "before"), ("B", "A", "p", "other", "x")]
    df = spark.createDataFrame(rows, "b string, a string, p string, l string, s string")
    nb, na = P.insert_prompt("b", "a", "p", "l", "s")
    got = [tuple(r) for r in df.select(nb, na).collect()]
    assert got == [("pB", "A"), ("Bp", "A"), ("B", "Ap"), ("B", "pA"), ("B", "A")]


def test_prompt_key_and_labels(spark):
    df = spark.createDataFrame([("x\ny", "? ")], "b string, a string")
    key = df.select(P.prompt_key("b", "a")).first()[0]
    assert key == "x\\ny{{ QUESTION }}? "
    assert _one(spark, [(key,)], P.strip_boilerplate("x")) == ["x\\ny{{ QUESTION }}"]


def test_rougel_engines_agree(spark):
    from groundeval.plans import fixtures as fx

    from conftest import SF001

    p = fx.pairs(spark, SF001)
    columns = ["pair_id", "em", "f1", "rougel"]
    a = M.score_pairs(p).select(*columns)
    b = M.score_pairs(p, engine="jvm").select(*columns)
    assert sorted(a.collect()) == sorted(b.collect())


def test_scores_of_missing_texts(spark):
    rows = [(1, None, None, ["a"]), (2, "", "", [""]), (3, "x", "x", []), (4, "x", "x", None), (5, "a the X!", "x y", [None, "x", "y x y"])]
    df = spark.createDataFrame(rows, "k int, answer string, explanation string, golds array<string>")
    got = {r.k: (r.em, r.f1, r.rougel) for r in M.score_pairs(df).collect()}
    assert got == {1: (0.0, 0.0, 0.0), 2: (1.0, 0.0, 0.0), 3: (None,) * 3, 4: (None,) * 3, 5: (1.0, 1.0, 0.8)}


def test_bleu_engines_agree(spark):
    from groundeval.plans import fixtures as fx

    from conftest import SF001

    p = fx.pairs(spark, SF001).withColumn("run_id", F.col("conv_id") % 3)
    a = M.corpus_bleu(p, "pair_id", "explanation", "golds", group=["run_id"]).orderBy("run_id").collect()
    b = M.corpus_bleu(p, "pair_id", "explanation", "golds", group=["run_id"], engine="jvm").orderBy("run_id").collect()
    assert [r.asDict() for r in a] == [r.asDict() for r in b]
    c = M.corpus_bleu(p, "pair_id", "explanation", "golds").collect()
    assert len(c) == 1 and 0.0 <= c[0].bleu <= 100.0


def test_format_fixed1_matches_python(spark):
    import random

    from groundeval.functions.format import format_fixed1

    rnd = random.Random(5)
    vals = [0.25, 0.35, 3.55, 2.675, 1.05, 0.05, 12.25, 0.15, 0.45, -0.04, -3.55, 0.0, 99.95, 1e6 + 0.05, 123456.789]
    vals += [rnd.uniform(0, 100) for _ in range(2000)] + [round(rnd.uniform(0, 100), 2) for _ in range(2000)]
    vals += [i / 100 for i in range(0, 10000, 5)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(format_fixed1("x")).collect()]
    assert got == ["%.1f" % v for v in vals]


def test_round_half_even_matches_python(spark):
    import math
    import random

    from groundeval.functions.format import round_half_even

    rnd = random.Random(6)
    vals = [0.0625, 0.1875, 0.0005, 0.0015, 1.0005, 2.6745, 2.6755, -0.0625, 0.0, 1 / 3, 99.9995, 12345.6785, 0.2125]
    vals += [rnd.uniform(-2, 2) for _ in range(3000)] + [rnd.randint(0, 64) / rnd.choice([16, 48, 80, 2000]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in [*vals, None, float("nan"), float("inf")]], "x double")
    got = [r[0] for r in df.select(round_half_even("x")).collect()]
    assert got[:-3] == [round(v, 3) for v in vals]
    assert got[-3] is None and math.isnan(got[-2]) and got[-1] == float("inf")


def test_stored_metrics_of_an_empty_run(spark):
    scored = spark.createDataFrame([(1, 1.0, 0.5, 1 / 3), (1, 0.0, 0.25, 1 / 3)], "run_id long, em double, f1 double, rougel double")
    runs = spark.createDataFrame([(1,), (2,), (2,)], "run_id long")
    got = sorted(tuple(r) for r in M.stored_metrics(scored, runs).collect())
    assert got == [(1, 0.5, 0.375, 0.333, 2), (2, 0.0, 0.0, 0.0, 0)]
