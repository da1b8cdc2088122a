import duckdb
import pytest

import __spark_entry__

QUERIES, ORACLE = __spark_entry__.queries(), __spark_entry__.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings chunks retrieved_chunks exam_questions exam_records dpo_pairs prompt_records profiles mix_targets".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: (round(v, 6) + 0.0 if v == v else "nan") if isinstance(v, float) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == canon(cur.fetchall(), columns)


#: Queries without SQL whose rows need not be there on the smallest tables.
MAY_BE_EMPTY = {"p8_found"}
#: Columns that make a row of a query without SQL unique.
KEYS = {
    "answer_keys": ["pair_id"], "similarity_ratio": ["pair_id"], "pair_select_ratio": ["question_ref"], "paired_bootstrap": ["arm"], "paired_intervals": ["comparison", "label", "judge", "metric"], "head_to_head_intervals": ["left", "right"],
    "ranking_quality_whole": ["query_id"], "training_losses_whole": ["query_id"], "p6_exams": ["exam_key"], "p6_passages": ["passage_key"], "p6_questions": ["question_key"], "p6_children": ["child_key"], "p6_nodes": ["record_id", "node"],
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_whole_rows_without_sql(spark, sf, name):
    """All columns are computed; keys are unique, queries named pN_found give distinct rows, and a second run gives the same."""
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    assert rows or name in MAY_BE_EMPTY
    if name in KEYS or name.endswith("_found"):
        at = [df.columns.index(c) for c in KEYS.get(name, df.columns)]
        assert len({tuple(r[i] for i in at) for r in rows}) == len(rows)
    assert canon([tuple(r) for r in QUERIES[name](spark, sf).collect()], df.columns) == canon(rows, df.columns)


def test_resampled_figures_agree_with_closed_forms(spark, sf):
    """Intervals lie around the mean about as wide as the normal approximation says."""
    report = {(r.comparison, r.label, r.judge, r.metric): r for r in QUERIES["paired_intervals"](spark, sf).collect()}
    exact = {(r.comparison, r.label, r.judge, r.metric): r for r in QUERIES["paired_report"](spark, sf).collect()}
    assert set(report) == set(exact)
    for k, r in report.items():
        assert abs(r.delta - exact[k].delta) < 1e-6 and r.n == exact[k].n and r.low <= r.delta <= r.high
        assert 1 / 10_001 <= r.p <= 1 and r.p <= r.p_holm <= 1
    for r in QUERIES["head_to_head_intervals"](spark, sf).collect():
        assert 0 <= r.low <= r.mean <= r.high <= 1
    for r in QUERIES["paired_bootstrap"](spark, sf).collect():
        assert r.low <= r.mean <= r.high and r.p <= r.p_holm


def test_production_pairs(spark, sf):
    """Pairs selected by the similarity of normalised texts, against plain code over the candidates."""
    import difflib
    import unicodedata

    from corvane.plans import preferences as plan

    def norm(t):
        return " ".join(unicodedata.normalize("NFKC", t).split()).strip(" .،؛:!?؟\"'«»")

    groups = {}
    for r in plan._candidates(spark, sf).collect():
        groups.setdefault(r.question_ref, []).append((r.score, r.seq, r.answer))
    want = {}
    for g, c in groups.items():
        c.sort(key=lambda x: (-x[0], x[1]))
        top = c[0]
        for s, _, t in reversed(c[1:]):
            if top[0] < 0.6 or top[0] - s < 0.05:
                break
            if difflib.SequenceMatcher(None, norm(top[2]), norm(t), autojunk=False).ratio() < 0.9:
                want[g] = (top[2], t)
                break
    assert {r.question_ref: (r.chosen, r.rejected) for r in QUERIES["pair_select_ratio"](spark, sf).collect()} == want and want


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
