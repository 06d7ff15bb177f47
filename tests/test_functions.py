"""Parsing, metrics, statistics, programs, sampling, staged runs."""

import json
import math

import pytest
from pyspark.sql import functions as F

from loomstone.functions import setmetrics as M
from loomstone.functions import text as X
from loomstone.functions.answers import parse, parsed_answer
from loomstone.operators import audits, perturb, programs, sampling, stats
from loomstone.sources import files
from loomstone.streaming import staged


@pytest.mark.parametrize(
    ("reply", "expected"),
    [
        ("10, 9,9", ("high", "9,10")),
        ('{"answer": ["b","3"]}', ("high", "3,b")),
        ("None", ("high", "None")),
        ("空集", ("high", "None")),
        ("some reasoning\nAnswer: 4, 5", ("medium", "4,5")),
        ('a\nb {"answers":[7]} c\nd', ("medium", "7")),
        ("x y\nSo the result is {8}.", ("low", "8")),
        ("(1,2,3)", ("high", "1,2,3")),
        ("see (1,2,3)", ("failed", None)),
        ("5, none", ("failed", None)),
        ("CONTEXT_OVERFLOW", ("failed", None)),
        ("", ("failed", None)),
        (None, ("failed", None)),
        ('{"answer": true}', ("failed", None)),
    ],
)
def test_answer_parser(reply, expected):
    assert parse(reply) == expected


def test_answer_column(spark):
    df = spark.createDataFrame([("1,2",), (None,)], "x string").select(parsed_answer("x").alias("p")).select("p.*")
    assert [tuple(r) for r in df.collect()] == [("high", "1,2"), ("failed", None)]


@pytest.mark.parametrize(
    ("pred", "gold", "rule", "em", "f1"),
    [
        ([], [], "canonical", 1, 1.0), ([], [], "executor", 1, 0.0), ([], [], "staged", 1, 1.0),
        ([1, 2], [2, 3], "canonical", 0, 0.5), ([], [1], "reporting", 0.0, 0.0), ([1, 2, 3], [1, 2], "executor", 0, 0.8),
        (None, [], "staged", 0, 0.0), (None, [], "canonical", 1, 1.0),
    ],
)
def test_metrics(spark, pred, gold, rule, em, f1):
    df = spark.createDataFrame([(pred, gold)], "p array<bigint>, g array<bigint>")
    row = df.select(*[c.alias(n) for n, c in M.metrics(F.col("p"), F.col("g"), rule).items()]).first()
    assert row.exact_match == em and row.f1 == pytest.approx(f1)


def test_extraction(spark):
    row = spark.createDataFrame([("a ( 1, 2 ,3)(4,5,6) Which entities are connected to entity 7 by relation 8? Answer: {1} Answer: {2,3}",)], "t string").select(
        X.triples(F.col("t")).alias("x"), X.question_entities(F.col("t")).alias("e"), X.question_relations(F.col("t")).alias("r"), X.final_answer(F.col("t")).alias("a")
    ).first()
    assert [tuple(x) for x in row.x] == [(1, 2, 3), (4, 5, 6)] and row.e == [7] and row.r == [8] and row.a == "2,3"
    sets = spark.createDataFrame([("None",), ("",), ("3,1, 3",), ("x",), (None,)], "t string").select(X.strict_set(F.col("t")).alias("s"), X.lenient_set(F.col("t")).alias("l")).collect()
    assert [r.s for r in sets] == [[], None, [1, 3], None, None] and [r.l for r in sets] == [[], [], ["1", "3"], ["x"], []]


def test_literals(spark):
    df = spark.createDataFrame([("{2, 1}",), ('{"a": [1]}',), ("(1,(2,))",), ("oops(",), (None,)], "t string")
    assert [r.x for r in df.select(files.literal_json(F.col("t")).alias("x")).collect()] == ["[1, 2]", '{"a": [1]}', "[1, [2]]", None, None]


def test_long_numbers_and_placeholders(spark):
    """Digit runs of any length, placeholders of any number, replies that no reader can take."""
    from loomstone.plans import prompts

    row = spark.createDataFrame([("a 007 7 12345678901234567890 3 (12345678901234567890,1,2)",)], "t string").select(X.numbers(F.col("t")).alias("n"), X.triples(F.col("t")).alias("x")).first()
    assert row.n == ["1", "2", "3", "007", "7", "12345678901234567890"] and row.x[0].h is None and row.x[0].r == 1
    df = spark.createDataFrame([("x [PP4] y [PP1] [PP12]", [str(i) for i in range(1, 13)]), ("none", None), ("[PP1] [PP2]", [None, "[PP1]"])], "t string, a array<string>")
    assert [r.o for r in df.select(prompts.with_answers(F.col("t"), F.col("a")).alias("o")).collect()] == ["x {4} y {1} {12}", "none", "{None} {[PP1]}"]
    for bad in ("[PP4]", "[PP0]", "[PP99999999999]"):
        with pytest.raises(Exception, match="no answer for"):
            spark.createDataFrame([(bad, ["1", "2", "3"])], "t string, a array<string>").select(prompts.with_answers(F.col("t"), F.col("a"))).collect()
    assert parse("[" * 100_000)[0] in ("high", "failed") and parse('{"answer": ' + "9" * 5000 + "}") == ("failed", None)
    assert parse("3, " + "9" * 5000)[1] == "3," + "9" * 5000 and parse('{"a":' * 3000)[0] in ("high", "failed")


def test_exact_signed_ranks(spark):
    import itertools

    for n in (1, 3, 6):
        sums = [sum(r * s for r, s in zip(range(1, n + 1), signs)) for signs in itertools.product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 2 + 1):
            assert stats.signed_rank_p(w, n) == pytest.approx(min(1.0, 2 * min(sum(s <= w for s in sums), sum(s >= w for s in sums)) / len(sums)))
    pairs = spark.createDataFrame([("c", i, float(d)) for i, d in enumerate((1, 2, 3, 4, 5, -6.5))], "contrast string, sample int, d double")
    assert stats.paired_tests(pairs, ["contrast"], 1).first().wilcoxon_p == pytest.approx(stats.signed_rank_p(15, 6))
    assert stats.signed_rank_p(0, 400) < 1e-100 and stats.signed_rank_p(40_100, 400) == pytest.approx(1.0, abs=1e-3)
    cells = spark.range(29)
    assert tuple(stats.planned(cells, 29).first()) == (29, 29)
    with pytest.raises(Exception, match="29 tests where 30 were planned"):
        stats.planned(cells, 30).collect()


def test_ranks_of_a_long_group(spark):
    """A group of many ties, one of a null key and one of a single row, against ranks by sorting."""
    import random

    r = random.Random(3)
    rows = [("x", i, r.choice([0.0, 0.25, -0.25, 0.5, -1.0, r.random()])) for i in range(900)] + [(None, i, float(i % 3 - 1)) for i in range(30)] + [("one", 0, 0.5)]
    pairs = spark.createDataFrame(rows, "contrast string, sample int, d double").repartition(6)
    want = {}
    for c in {x[0] for x in rows}:
        mine = sorted((round(abs(d), 12), s) for g, s, d in rows if g == c)
        for v in {v for v, _ in mine}:
            at = [i for i, (w, _) in enumerate(mine, 1) if w == v]
            want |= {(c, mine[i - 1][1]): sum(at) / len(at) for i in at}
    assert {(x.contrast, x.sample): x.rank for x in stats.wilcoxon_ranks(pairs, ["contrast"]).collect()} == want
    tests = {x.contrast: x for x in stats.paired_tests(pairs, ["contrast"]).collect()}
    assert set(tests) == {"x", None, "one"} and tests["one"].wilcoxon_p == 1.0 and math.isnan(tests["one"].t_p)
    for c, x in tests.items():
        plus = sum(want[c, s] for g, s, d in rows if g == c and d > 0)
        minus = sum(want[c, s] for g, s, d in rows if g == c and d < 0)
        assert x.statistic == pytest.approx(min(plus, minus))
        squares = sum(want[c, s] ** 2 for g, s, d in rows if g == c and d)
        assert x.z == pytest.approx((plus - minus) / 2 / math.sqrt(squares / 4))
    assert stats.paired_tests(pairs.where("false"), ["contrast"]).count() == 0
    report = {(x.scope, x.contrast): x for x in stats.significance(stats.paired_tests(pairs, ["contrast"]), [[], ["contrast"]]).collect()}
    assert report["overall", None].n == 3 and report["contrast", "x"].t_significant == tests["x"].t_significant


def test_model_over_http(spark):
    """Replies over HTTP, a busy server tried again, an error that ends the job."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from loomstone.streaming import remote

    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            calls.append(body)
            said = body["messages"][1]["content"]
            self.send_response(503 if said == "busy" and len(calls) < 3 else 400 if said == "bad" else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": '{"answer": ["' + said[-1] + '"]}'}}]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    model = remote.http_model(f"http://127.0.0.1:{server.server_port}/chat", "m", "be brief", wait=0.01, temperature=0.05)
    assert model(["busy"]) == ['{"answer": ["y"]}'] and len(calls) == 3 and calls[0]["messages"][0]["content"] == "be brief" and calls[0]["temperature"] == 0.05
    with pytest.raises(Exception, match="400"):
        model(["bad"])
    df = spark.createDataFrame([(1, "is 7"), (2, "is 8")], "qid int, prompt string")
    assert sorted((r.qid, r.answer) for r in remote.one_shot(df, model).collect()) == [(1, ["7"]), (2, ["8"])]
    assert sorted((r.qid, r.answer) for r in remote.few_shot(df, model).collect()) == [(1, ["7"]), (2, ["8"])]
    steps = spark.createDataFrame([(1, 1, "is 7"), (1, 2, "after [PP1] is 9")], "qid int, step int, prompt string")
    assert remote.staged(steps, model).first().answers == ["7", "9"] and calls[-1]["messages"][1]["content"] == "after {7} is 9"
    server.shutdown()


def test_record_loaders(spark, tmp_path):
    from loomstone.sources import records

    (tmp_path / "s" / "2p").mkdir(parents=True)
    (tmp_path / "s" / "2p" / "3.txt").write_text(str({"query": "the prompt", "answer": "{5}"}))
    assert [tuple(r) for r in records.single_prompts(spark, str(tmp_path / "s")).collect()] == [("2p", 3, "the prompt", "{5}")]
    (tmp_path / "t" / "2p").mkdir(parents=True)
    (tmp_path / "t" / "2p" / "4.txt").write_text(str({"query": {"premise": ["P1 ", "P2 "], "question": {"question_tag": "Q:", "question": {"2p": ["one", "two"], "1p": ["x"]}, "explain_tag": "!"}}, "answer": "5"}))
    assert [tuple(r) for r in records.step_prompts(spark, str(tmp_path / "t")).orderBy("step").collect()] == [("2p", 4, 1, "P1 Q:one!", "5"), ("2p", 4, 2, "P2 Q:two!", "5")]
    text = spark.createDataFrame([("2p", 1, "(1,2,3),(4,5,6)\nAnswer the question:\n(7,8,9)")], "qtype string, sample_id int, prompt string")
    assert sorted((r.h, r.r, r.t) for r in records.premises(text, "Answer the question:").collect()) == [(1, 2, 3), (4, 5, 6)]
    score = {f: 1.0 for f in records.SCORE_FIELDS}
    lacking = {k: v for k, v in score.items() if k != "recall"}
    df = spark.createDataFrame([("m", "x", "1p", 1, json.dumps(score))], "model string, method string, qtype string, sample int, text string")
    assert records.scores(df).first().f1 == 1.0
    with pytest.raises(Exception, match="without recall"):
        records.scores(df.withColumn("text", F.lit(json.dumps(lacking)))).collect()
    cost = {f: 2 for f in records.COST_FIELDS} | {"model": "m", "method": "x", "qtype": "1p"}
    assert records.efficiencies(df.withColumn("text", F.lit(json.dumps(cost))), 2).first().total_calls == 2
    for wrong, match in ((cost | {"model": "n"}, "another's place"), ({k: v for k, v in cost.items() if k != "num_batches"}, "num_batches")):
        with pytest.raises(Exception, match=match):
            records.efficiencies(df.withColumn("text", F.lit(json.dumps(wrong)))).collect()
    with pytest.raises(Exception, match="another number"):
        records.efficiencies(df.withColumn("text", F.lit(json.dumps(cost))), 3).collect()
    test = spark.createDataFrame([("q", "(1,2,3) connected to entity 1 by relation 2", "{3, 4}")], "k string, query string, answer string")
    r = records.test_records(test, "k").first()
    assert r.entities == [1, 3] and r.relations == [2] and r.answers == ["3", "4"] and r.signature == "2"
    (tmp_path / "v.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    assert sorted(x.a for x in records.source_split(spark, str(tmp_path / "v.json"), "val", "a int").collect()) == [1, 2]
    with pytest.raises(ValueError, match="no split"):
        records.source_split(spark, "x", "test", "a int")


def test_comparisons_fail_loudly(spark):
    from loomstone.operators import comparisons, costs, summaries

    a = spark.createDataFrame([(1, 0.5), (2, 0.25)], "k int, f1 double")
    with pytest.raises(Exception, match="no partner"):
        comparisons.side_by_side(a, a.where("k = 1"), ["k"], ["f1"]).collect()
    gold = spark.createDataFrame([(1, "s", "g"), (2, "t", "h")], "k int, source string, answer string")
    with pytest.raises(Exception, match="disagree"):
        comparisons.zipped(gold, gold.withColumn("source", F.lit("s")).select("k", "source", F.lit("p").alias("pred")), ["k"], "source").collect()
    with pytest.raises(Exception, match="another source"):
        comparisons.gold_of(spark.createDataFrame([(2, "s")], "k int, source string"), gold, "k", "source", "answer").collect()
    with pytest.raises(Exception, match="group of 3"):
        summaries.complete(spark.createDataFrame([("x", 3)], "g string, n bigint"), 150).collect()
    c = spark.createDataFrame([("m", "x", "1p", 1, 5, 1, 0.5, 0)], "model string, method string, qtype string, sample int, input_tokens int, output_tokens int, seconds double, batch int")
    accuracy = spark.createDataFrame([("m", "x", "2p", 0.5, 0.5)], "model string, method string, qtype string, f1 double, em_rate double")
    with pytest.raises(Exception, match="no partner"):
        costs.accuracy_cost(accuracy, costs.efficiency(c)).collect()


def test_dynamic_run(spark):
    """Unread and terminal replies in a run that retrieves by the answers before it."""
    from loomstone.streaming.dynamic import run_dynamic

    plan = spark.createDataFrame([(1, 10, 1, 2), (2, 20, 1, 2), (3, 30, 1, 2), (4, 40, 1, 2)], "qid bigint, e1 bigint, r1 int, r2 int")
    kg = spark.createDataFrame([(10, 1, 11), (11, 2, 12), (99, 2, 98), (20, 1, 21), (30, 1, 31)], "h bigint, r int, t bigint")

    def model(prompts):
        return ["CONTEXT_OVERFLOW" if "(30," in p else "because of entities" if "(20," in p else "11, 99" if "(10," in p else "None" if "(" not in p.split("Answer the")[0].split("ignore")[1] else "12, 98" for p in prompts]

    found, premises = run_dynamic(plan, "2p", kg, model, done=spark.createDataFrame([(4,)], "qid bigint"))
    rows = {r.qid: r for r in found.collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[1].answers == ["11,99", "12,98"] and rows[1].status == "ok" and rows[1].total_input_chars == sum(rows[1].input_chars)
    assert rows[2].statuses == ["parse_failed", "ok"] and rows[2].answers == ["None", "None"] and rows[2].status == "failed"
    assert rows[3].statuses == ["context_overflow", "skipped_previous_failure"] and rows[3].input_chars[1] is None and rows[3].total_input_chars == rows[3].input_chars[0]
    assert sorted((r.qid, r.step, r.h, r.t) for r in premises.collect()) == [(1, 1, 10, 11), (1, 2, 11, 12), (1, 2, 99, 98), (2, 1, 20, 21), (3, 1, 30, 31)]


def test_tails():
    assert stats.t_tail(2.0, 10) == pytest.approx(0.07339, abs=1e-4)
    assert stats.t_quantile(0.975, 99) == pytest.approx(1.98422, abs=1e-4)
    assert stats.normal_tail(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert stats.t_tail(math.inf, 5) == 0.0


def test_paired(spark):
    rows = [("m", s, x, v) for s, (a, b) in enumerate([(0.0, 1.0), (0.5, 0.5), (0.2, 0.1), (0.0, 0.4)]) for x, v in (("A", a), ("B", b))]
    pairs = stats.paired(spark.createDataFrame(rows, "model string, sample int, method string, f1 double"), [("A", "B")], ["model"], "sample", "f1")
    r = stats.paired_tests(pairs, ["model", "contrast"], family=3).first()
    assert (r.n, r.wins, r.ties, r.losses) == (4, 2, 1, 1) and r.delta == pytest.approx(0.325)
    ranks = {x.sample: x.rank for x in stats.wilcoxon_ranks(pairs, ["model", "contrast"]).collect()}
    assert ranks == {1: 1.0, 2: 2.0, 3: 3.0, 0: 4.0}
    same = pairs.withColumn("d", F.lit(0.0))
    s = stats.paired_tests(same, ["model", "contrast"]).first()
    assert (s.t_p, s.wilcoxon_p, s.dz, s.ci_low) == (1.0, 1.0, 0.0, 0.0)


def test_malformed_and_shared_programs(spark):
    good = [{"function": "Find", "dependencies": [], "inputs": ["A"]}, {"function": "Relate", "dependencies": [0], "inputs": ["p", "forward"]}]
    odd = [5, None, "x", [], {}, {"function": []}, {"function": {"a": 1}}, {"function": "Find", "inputs": 5}, {"function": "Find", "inputs": {"a": 1}}, {"function": "Find", "inputs": [None]}, {"function": "Find", "inputs": [["a"]]}]
    odd += [{"function": "Relate", "dependencies": d, "inputs": ["p", "forward"]} for d in (5, "0", {"a": 0}, [True], ["0"], [7], [-1], [None], [[0]], [0, 0])]
    odd += [{"function": "And", "dependencies": d} for d in ([], [0], [0, 9], 3)] + [{"function": "What", "dependencies": []}, {"function": "Relate", "dependencies": [0], "inputs": ["p", 7]}]
    texts = [json.dumps(good[:n] + [x]) for x in odd for n in (0, 1, 2)] + ["[", "5", "null", "{}", "[" * 5000, "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid int, program string").select("qid", programs.analysed("program").alias("a")).select("qid", "a.*").collect()
    assert len(rows) == len(texts) and all(r.nodes is None and r.reason for r in rows)
    number = programs.analysis(json.dumps([{"function": "Find", "inputs": [5]}, good[1]]))
    assert number[1] == "1p" and number[4][0]["name"] == "5"
    # A step that both sides of each group need: twenty levels would unfold to a million nodes.
    twice = good + [{"function": "And" if i % 2 else "Or", "dependencies": [i + 1, i + 1]} for i in range(12)]
    shape, qtype, reason, _, nodes = programs.analysis(json.dumps(twice))
    assert len(nodes) == 14 and qtype is None and reason == "unsupported_shape" and len(shape) < 200 and "#" in shape
    long = good + [{"function": "Relate", "dependencies": [i + 1], "inputs": ["p", "forward"]} for i in range(3000)]
    assert len(programs.analysis(json.dumps(long))[4]) == 3002
    table = spark.createDataFrame([(1, n) for n in nodes], "qid int, n struct<node:int,kind:string,left:int,right:int,name:string,height:int>").select("qid", "n.*")
    names = spark.createDataFrame([("q1", "A")], "id string, name string")
    edges = spark.createDataFrame([("q1", "p", "forward", "q2"), ("q1", "p", "backward", "q3")], "h string, predicate string, direction string, t string")
    assert [tuple(x) for x in programs.executed(table, names, edges).collect()] == [(1, "q2")]


def test_programs(spark):
    step = lambda f, d=(), i=(): {"function": f, "dependencies": list(d), "inputs": list(i)}
    two = [step("Find", i=["A"]), step("Relate", [0], ["p", "forward"]), step("FilterConcept", [1], ["c"]), step("Relate", [2], ["q", "backward"]), step("What", [3])]
    assert programs.tree(two) == ("P", "q", "backward", ("P", "p", "forward", ("A", "A")))
    assert programs.components(programs.tree(two)) == [{"anchor": "A", "path": ["p::forward", "q::backward"]}]
    both = [step("Find", i=["A"]), step("Relate", [0], ["p", "forward"]), step("Find", i=["B"]), step("Relate", [2], ["q", "forward"]), step("Or", [1, 3]), step("Count", [4])]
    df = spark.createDataFrame([(json.dumps(two),), (json.dumps(both[:5]),), (json.dumps(both),)], "p string").select(programs.analysed("p").alias("a")).select("a.*").collect()
    assert [r.qtype for r in df] == ["2p", "2u", None] and df[2].shape == "X"
    shared = [step("Find", i=["A"])] + [step("And", [k, k]) for k in range(60)]
    assert [programs.analysis(x)[2] for x in ("{", "", None, "7", "[1]", json.dumps(shared), "[" * 5000)] == ["invalid_json", "empty", "empty", "empty", "unsupported_shape", "unsupported_shape", "invalid_json"]
    nested = [step("Find", i=["A"]), step("Relate", [0], ["p", "forward"]), step("Relate", [1], ["p", "backward"]), step("Or", [1, 2]), step("Relate", [3], ["q", "forward"])]
    assert [(n["kind"], n["height"]) for n in programs.flattened(programs.tree(nested))] == [("A", 0), ("P", 1), ("P", 2), ("U", 3), ("P", 4)]


def test_parse_and_score():
    ok = {"type": "2i", "query": [{"anchor": "A", "path": [{"relation": "r", "direction": "forward"}]}, {"anchor": "B", "path": [{"relation": "s", "direction": "backward"}]}]}
    assert programs.parsed(json.dumps(ok)) == (ok, None)
    turned = {"type": "2i", "query": ok["query"][::-1]}
    assert programs.score(ok, turned)["exact_correct"] == 1.0
    assert programs.score(ok, None)["anchor_total"] == 2.0
    for bad, why in (("{", "invalid_json"), ("[]", "top_level_not_object"), ('{"type":"1p"}', "invalid_top_level_fields"), ('{"type":"9p","query":[]}', "invalid_qtype"), ('{"type":"1p","query":[]}', "invalid_branch_count"), ('{"type":"1p","query":[{"anchor":" ","path":[]}]}', "invalid_anchor"), ('{"type":"1p","query":[{"anchor":"a","path":[{"relation":"r","direction":"up"}]}]}', "invalid_direction")):
        assert programs.parsed(bad) == (None, why)
    assert programs.normal_name("  Ｓtraße  X ") == "strasse x"


def test_knowledge_base(spark):
    parts = spark.createDataFrame([(1, 0, "A", ["p::forward"]), (1, 1, "B", ["p::forward"]), (2, 0, "A", ["p::forward", "p::backward"])], "qid int, branch int, anchor string, path array<string>")
    names = spark.createDataFrame([("1", "A"), ("2", "B")], "id string, name string")
    edges = spark.createDataFrame([("1", "p", "forward", "3"), ("2", "p", "forward", "3"), ("1", "p", "forward", "4"), ("3", "p", "backward", "1"), ("3", "p", "backward", "2")], "h string, predicate string, direction string, t string")
    found = sorted((r.qid, r.ent) for r in programs.executed_paths(parts, names, edges).collect())
    assert found == [(1, "3"), (2, "1"), (2, "2")]
    long = spark.createDataFrame([(1, 0, "A", ["p::forward", "p::backward", "p::forward"]), (2, 0, "A", ["p::forward"] + ["p::backward", "p::forward"] * 2), (3, 0, "A", ["p::forward"]), (3, 1, "B", ["p::forward"])], "qid int, branch int, anchor string, path array<string>")
    assert sorted((r.qid, r.ent) for r in programs.executed_paths(long, names, edges, union=True).collect()) == [(1, "3"), (1, "4"), (2, "3"), (2, "4"), (3, "3"), (3, "4")]
    assert programs.executed_paths(long.where("false"), names, edges).count() == 0


def test_distractors(spark):
    kg = spark.createDataFrame([(h, r, (h * 7 + r * 3 + k) % 20) for h in range(20) for r in range(4) for k in range(2)], "h bigint, r int, t bigint").distinct()
    steps = kg.where("h = 1 AND r = 2").select(F.lit(0).alias("qid"), F.lit(1).alias("step"), "h", "r", "t")
    phases = spark.createDataFrame([(0, 1, 2), (0, 2, None)], "qid int, step int, relation int")
    noise = perturb.distractors(steps, kg, phases, 3.0, 3, 9).collect()
    assert len(noise) == 6 and {r.step for r in noise} == {1}
    assert sorted(r["class"] for r in noise) == [1, 1, 2, 2, 3, 3]
    assert all((r["class"] == 1) == (r.h == 1 and r.r != 2) and (r["class"] == 2) == (r.h != 1 and r.r == 2) for r in noise)
    assert not perturb.distractors(steps, kg, phases, 0.0).count()
    five = [r["class"] for r in perturb.distractors(steps, kg, phases, 1.0, 5, 5).collect()]
    assert sorted(five) == [1, 1, 2, 2, 3]
    # Whatever a class lacks is found elsewhere, until the graph has no more.
    small = kg.where("h IN (1, 2) AND r IN (2, 3)")
    taken = perturb.distractors(steps, small, phases, 9.0, 1, 30).collect()
    assert {(r.h, r.r, r.t) for r in taken} == {tuple(r) for r in small.where("NOT (h = 1 AND r = 2)").collect()} and len(taken) == len({(r.h, r.r, r.t) for r in taken})
    heads = spark.createDataFrame([(0, 1, h, 2, 0) for h in range(19)], "qid int, step int, h bigint, r int, t bigint")
    far = perturb.distractors(heads, kg, phases, 0.1, 9, 9).where("class = 2").collect()
    assert len(far) == kg.where("h = 19 AND r = 2").count()


def test_distractors_write_what_phases_meet(spark, monkeypatch):
    kg = spark.range(20_000).select((F.col("id") % 4000).alias("h"), (F.col("id") % 2).cast("int").alias("r"), F.col("id").alias("t"))
    steps = kg.where("h = 7 AND r = 1").select(F.lit(0).cast("long").alias("qid"), F.lit(1).alias("step"), "h", "r", "t")
    phases = spark.createDataFrame([(0, 1, 1)], "qid bigint, step int, relation int")
    rows, write = [], perturb.written

    def counted(df, name):
        out = write(df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(perturb, "written", counted)
    draw = lambda **more: {tuple(r) for r in perturb.distractors(steps, kg, phases, 1.0, 5, 9, **more).collect()}
    once = draw()
    assert len(once) == 5 and sum(rows) < 1000
    # Triples that come several times are drawn once, and counted once.
    assert draw(repeated=kg.union(kg)) == once


def test_programs_read_the_predicates_they_name(spark):
    names = spark.createDataFrame([("1", "A")], "id string, name string")
    parts = spark.createDataFrame([(1, 0, "A", ["p::forward"])], "qid int, branch int, anchor string, path array<string>")
    edges = spark.createDataFrame([("1", "p", "forward", "3"), ("1", "q", "forward", "4"), ("1", "p", "backward", "5")], "h string, predicate string, direction string, t string")
    asked = (F.col("predicate") == "p") & (F.col("direction") == "forward")
    edges = edges.withColumn("t", F.when(asked, F.col("t")).otherwise(F.raise_error("read")))
    assert [tuple(r) for r in programs.executed_paths(parts, names, edges).collect()] == [(1, "3")]


def test_sampling_is_stable(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    a = {tuple(r) for r in sampling.per_group(df, ["g"], 4, "x", ["k"]).select("g", "k").collect()}
    b = {tuple(r) for r in sampling.per_group(df.repartition(7), ["g"], 4, "x", ["k"]).select("g", "k").collect()}
    assert a == b and len(a) == 12
    parts = sampling.split(df, ["g"], 0.9, "x", ["k"]).groupBy("g", "part").count().collect()
    assert {(r.g, r.part): r["count"] for r in parts}[0, "train"] == 30


def test_audits(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("a", 9)], "g string, i int")
    assert {(r.i, r.problem) for r in audits.incomplete(df, ["g"], "i", 1, 3).collect()} == {(2, "missing"), (9, "unexpected"), (3, "duplicate")}
    with pytest.raises(ValueError, match="gaps"):
        audits.require_none(audits.incomplete(df, ["g"], "i", 1, 3), "gaps")
    assert spark.createDataFrame([(1, 11), (2, 12)], "a int, b int").agg(audits.constant_offset(F.col("a"), F.col("b")).alias("o")).first().o == 10


def test_batches_and_memory():
    assert staged.batches([5, 1, 3, 9], 2, 100) == [[1, 2], [0, 3]]
    assert staged.batches([5, 1, 3, 9], 9, 9) == [[1, 2], [0], [3]]

    def model(prompts):
        if len(prompts) > 1 or prompts[0] == "bad":
            raise MemoryError
        return [p.upper() for p in prompts]

    assert staged.guarded(model, ["a", "bad", "long prompt"], context=8) == ["A", "CUDA_OOM", "CONTEXT_OVERFLOW"]


def test_staged_run(spark):
    prompts = spark.createDataFrame([(1, 1, "one"), (1, 2, "then [PP1]"), (2, 1, "CONTEXT"), (2, 2, "never [PP1]"), (3, 1, "words only"), (3, 2, "and [PP1]")], "qid int, step int, prompt string")

    def model(texts):
        return [{"one": "7", "CONTEXT": "CONTEXT_OVERFLOW", "words only": "because of entities"}.get(t, f"Answer: {t.split('{')[-1].rstrip('}')}") for t in texts]

    rows = {r.qid: r for r in staged.run_staged(prompts, model).collect()}
    assert rows[1].answers == ["7", "7"] and rows[1].status == "ok"
    assert rows[2].raw_answers[1] == staged.SKIPPED and rows[2].status == "context_overflow"
    assert rows[3].confidences == ["failed", "high"] or rows[3].answers == [None, "None"]
    done = spark.createDataFrame([(1,), (2,)], "qid int")
    assert [r.qid for r in staged.run_staged(prompts, model, done=done).collect()] == [3]


def test_incremental_run(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.json").write_text(json.dumps({"qid": 1, "step": 1, "prompt": "x"}) + "\n")
    for name in ("a", "b"):
        if name == "b":
            (src / "b.json").write_text(json.dumps({"qid": 2, "step": 1, "prompt": "y"}) + "\n")
        staged.run_incremental(spark, str(src), "qid int, step int, prompt string", str(out), lambda ps: ["5"] * len(ps), str(tmp_path / "cp"))
    assert sorted(r.qid for r in spark.read.parquet(str(out)).collect()) == [1, 2]
    # The checkpoint is lost, and a sample comes again beside a new one: only the new one runs.
    (src / "c.json").write_text(json.dumps({"qid": 1, "step": 1, "prompt": "x"}) + "\n" + json.dumps({"qid": 3, "step": 1, "prompt": "z"}) + "\n" + json.dumps({"qid": 3, "step": 1, "prompt": "z"}) + "\n")
    asked = tmp_path / "asked"
    asked.mkdir()

    def noting(prompts):
        for p in prompts:
            (asked / p).write_text("")
        return ["5"] * len(prompts)

    staged.run_incremental(spark, str(src), "qid int, step int, prompt string", str(out), noting, str(tmp_path / "cp2"))
    assert sorted(r.qid for r in spark.read.parquet(str(out)).collect()) == [1, 2, 3] and [x.name for x in asked.iterdir()] == ["z"]


def test_sources(spark, tmp_path):
    from loomstone.sources import graph

    (tmp_path / "kg.csv").write_text("﻿head,relation,tail\n1,2,3\n1,2,3\n4,5,6\n", encoding="utf-8")
    kg = graph.read_triples(spark, str(tmp_path / "kg.csv"))
    assert sorted(map(tuple, kg.collect())) == [(1, 2, 3), (4, 5, 6)]
    graph.write_triples(kg, str(tmp_path / "kg"))
    assert spark.read.parquet(str(tmp_path / "kg")).where("r = 5").first().h == 4
    for folder, text in (("q", "(1,(2,))"), ("a", "{3}")):
        (tmp_path / folder / "1p").mkdir(parents=True)
        (tmp_path / folder / "1p" / "10.txt").write_text(text)
    b = files.benchmark(spark, str(tmp_path / "q"), str(tmp_path / "a")).first()
    assert (b.qtype, b.sample_id, b.query, b.answer) == ("1p", 10, "(1,(2,))", "{3}")
    kb = {"entities": {"x": {"name": "X", "relations": [{"predicate": "p", "direction": "forward", "object": "y"}]}, "y": {"name": "X", "relations": []}}, "concepts": {}}
    (tmp_path / "kb.json").write_text(json.dumps(kb))
    names, edges = graph.read_kb(spark, str(tmp_path / "kb.json"))
    assert graph.name_index(names).first().ids == ["x", "y"] and edges.count() == 1
    assert {r.rel_key: r.rel_id for r in graph.relation_ids(edges).collect()} == {"p::forward": 1, "p::backward": 2}


def test_old_results_and_staged_answers(spark):
    rows = spark.createDataFrame([(1, " a, b @\n @ c\n"), (2, "@@")], "k int, text string")
    assert [x.parts for x in files.legacy_results(rows).orderBy("k").collect()] == [["a, b", "c"], ["", ""]]
    assert files.legacy_results(spark.createDataFrame([("1 @@ 2@ @3",)], "text string"), parts=3).first().parts == ["1", "2", "3"]
    for bad in ("a @ b", "a", "a @@ b @@ c", ""):
        with pytest.raises(Exception, match="a result without 2 parts"):
            files.legacy_results(spark.createDataFrame([(bad,)], "text string")).collect()
    whole = json.dumps({"answers": ["1", None], "raw_answers": ["x", "y"], "confidences": ["high", "failed"], "status": "ok"})
    got = files.staged_answers(spark.createDataFrame([(7, whole)], "k int, text string")).orderBy("stage").collect()
    assert [tuple(x) for x in got] == [(7, 1, "1", "x", "high", "ok"), (7, 2, None, "y", "failed", "ok")]
    with pytest.raises(Exception, match="lists of unequal length"):
        files.staged_answers(spark.createDataFrame([(json.dumps({"answers": ["1"], "raw_answers": [], "confidences": ["high"]}),)], "text string")).collect()


def test_aligned_folders_and_reports(spark, tmp_path):
    for folder in ("q", "a", "p", "b"):
        (tmp_path / folder / "2p").mkdir(parents=True)
        for n in (1, 2):
            (tmp_path / folder / "2p" / f"{n}.txt").write_text(f"{folder}{n}")
    folders = {n: str(tmp_path / n) for n in ("q", "a", "p", "b")}
    assert [tuple(x) for x in files.aligned(spark, folders).orderBy("sample_id").collect()] == [("2p", 1, "q1", "a1", "p1", "b1"), ("2p", 2, "q2", "a2", "p2", "b2")]
    (tmp_path / "q" / "2p" / "3.txt").write_text("q3")
    with pytest.raises(Exception, match="2p/3 is not in a, p, b"):
        files.aligned(spark, folders).collect()
    small = spark.createDataFrame([("x", 0.5, None), ("y", 1.0, [1, 2])], "name string, share double, ids array<int>")
    text = files.report("Whole", [("Words", "Some words."), ("Rows", small)])
    assert text.startswith("# Whole\n") and "## Words\n\nSome words." in text and "| x | 0.5000 | NA |" in text
    files.write_pretty(small, str(tmp_path / "pretty"))
    raw = "\n".join(x.value for x in spark.read.option("wholetext", True).text(str(tmp_path / "pretty")).collect())
    assert json.loads(raw)[1] == {"name": "y", "share": 1.0, "ids": [1, 2]} and "\n" in raw.strip()
    with pytest.raises(Exception, match="a report is made of a summary"):
        files.write_pretty(small, str(tmp_path / "more"), most=1)
    files.write_samples(spark.range(50).selectExpr("'m' AS method", "'2p' AS qtype", "id"), str(tmp_path / "samples"))
    assert spark.read.json(str(tmp_path / "samples")).count() == 50


def test_audited_entities_and_failure_rates(spark):
    from loomstone.operators import summaries

    asked = "Which are connected to entities  in 12 by relation 3, connected  to 5 and connected to entity 9?"
    found = spark.createDataFrame([(asked,)], "q string").select(X.question_entities(F.col("q"), True).alias("a"), X.question_entities(F.col("q")).alias("b")).first()
    assert found.a == [12, 5, 9] and found.b == [9]
    rows = [("m", 1, 0, "ok"), ("m", 1, 1, "ok"), ("m", 2, 0, "cuda_oom"), ("m", 2, None, None), ("m", 3, 0, "ok")]
    x = summaries.failure_rates(spark.createDataFrame(rows, "model string, sample int, parse_failed int, status string"), ["model"]).first()
    assert x.n == 3 and x.parse_failure_rate == pytest.approx(1 / 3) and x.status_failure_rate == pytest.approx(1 / 3) and x.any_failure_rate == pytest.approx(2 / 3)


def test_rounded_text_has_no_exponent(spark):
    from loomstone.functions.text import rounded_text

    values = [0.00042, -0.0007, -0.00001, 0.0, 12.34, -3.0, 12345678.9, 0.67, 100.0]
    got = spark.createDataFrame([(x,) for x in values], "x double").select(rounded_text(F.col("x")).alias("x")).collect()
    assert [r.x for r in got] == ["0.0004", "-0.0007", "-0.0", "0.0", "12.34", "-3.0", "12345678.9", "0.67", "100.0"]


def test_long_answer_sets(spark):
    text = ", ".join(map(str, range(60_000, 0, -1)))
    odd = ["1,,2", "1, 2,", ",1", "1;2", "-", "3 , -2,3", " 7 ", "None", ""]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([text, text + ",x", *odd])], "i int, x string").select("i", X.strict_set(F.col("x")).alias("x")).orderBy("i").collect()
    assert rows[0].x == list(range(1, 60_001))
    assert [r.x for r in rows[1:]] == [None] * 6 + [[-2, 3], [7], [], None]
