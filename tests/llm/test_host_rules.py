from helpers import documents, empty, frame, measures, ordered

from demandloom.llm import host_rules as H


def test_measures_and_base_rules_equal_plain_python(spark):
    rows = documents()
    got = H.judge(frame(spark, rows)).select("doc_id", *H.MEASURES, "base_failed").collect()
    assert ordered(got) == ordered((r[0], *measures(r[1])) for r in rows)


def test_a_bad_host_takes_its_documents_with_it_and_small_ones_are_shrunk(spark):
    good, bad = " ".join(f"w{k}" for k in range(60)), "too short"
    rows = [(k, bad if k % 20 else good, "en", "bad", 0, "", 0, "") for k in range(400)]
    rows += [(1000 + k, good, "en", f"h{k % 30}", 0, "", 0, "") for k in range(3000)]
    rows += [(9000, bad, "en", "new", 0, "", 0, ""), (9001, good, "en", "new", 0, "", 0, ""), (9002, good, "en", None, 0, "", 0, "")]
    got = {r.doc_id: r for r in H.judge(frame(spark, rows)).collect()}
    assert not got[0].base_failed and got[0].host_rejected and not got[0].kept
    assert got[1000].kept and got[9001].kept and got[9002].kept
    assert got[9002].host_rate is None and 0 < got[9001].host_rate < 0.5
    kept = H.keep_good(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}


def test_empty_table(spark):
    assert H.judge(empty(spark)).count() == 0 and H.keep_good(empty(spark)).count() == 0


def test_plan_stays_in_the_jvm(spark):
    plan = H.judge(frame(spark, documents()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
