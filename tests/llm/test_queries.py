"""What must hold for the rows of registered queries that no SQL checks."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    held = {}

    def get(name):
        if name not in held:
            held[name] = QUERIES[name](spark, SF).collect()
        return held[name]

    return get


def read(spark, table):
    return spark.read.parquet(f"{SF}/{table}.parquet")


def test_pieces_cover_their_chunks(spark, rows):
    texts = {r.chunk_id: r.text.strip() for r in read(spark, "chunks").filter("text is not null").collect()}
    pieces = defaultdict(list)
    for r in rows("p1_pieces"):
        pieces[r.chunk_id].append(r)
    assert set(pieces) == {k for k, t in texts.items() if t}
    for k, ps in pieces.items():
        ps.sort(key=lambda p: p.piece)
        assert [p.piece for p in ps] == list(range(ps[0].pieces)) and ps[0].start == 0 and ps[-1].end == len(texts[k])
        assert all(len(p.piece_text) <= 800 and texts[k][p.start : p.end] == p.piece_text for p in ps)
        assert all(a.start < b.start <= a.end < b.end for a, b in zip(ps, ps[1:]))
    assert {r.chunk_id for r in rows("p1_found")} == {k for k, ps in pieces.items() if len(ps) > 1}


def test_ties_stay_together_and_shares_hold(spark, rows):
    split = {r.question_ref: r.split for r in rows("p2_splits")}
    refs = {r.question_ref for r in read(spark, "exam_questions").select("question_ref").distinct().collect()}
    assert set(split) == refs and len(rows("p2_splits")) == len(refs)
    assert all(split[r.anchor_ref] == split[r.question_ref] for r in rows("p2_found"))
    n = Counter(split.values())
    assert all(abs(n[s] / len(refs) - x) < 0.01 for s, x in (("train", 0.8), ("val", 0.1), ("test", 0.1)))


def test_forms_are_fixed_points(spark, rows):
    from corvane.llm.lookalike import Canonical

    form = Canonical([])
    assert all(r.form is None or form(r.form) == r.form for r in rows("p3_forms"))
    assert all(r.key_a < r.key_b for r in rows("p3_found"))


def test_labels_are_posteriors(rows):
    sides = Counter((r.pair_id, r.side) for r in rows("p4_labels"))
    assert set(sides.values()) == {1} and len({k for k, _ in sides}) * 2 == len(sides)
    assert all(0 <= r[d] <= 1 for r in rows("p4_labels") for d in ("empty", "refusal", "copy", "other_language", "truncated"))
    first = {(r.pair_id, r.side): r.defects.split(",")[0] for r in rows("p4_labels") if r.defects}
    assert {(r.pair_id, r.side): r.defect for r in rows("p4_found")} == first and len(rows("p4_found")) == len(first)


def test_overlaps_and_report_agree(rows):
    pairs = {(min(r.a, r.b), max(r.a, r.b)) for r in rows("p5_overlaps")}
    assert pairs == {(r.case_a, r.case_b) for r in rows("p5_found")} and pairs
    want = defaultdict(lambda: [0, set(), 0, 0])
    for r in rows("p5_overlaps"):
        w = want[r.eval_split, r.eval_source]
        w[0] += 1
        w[1].add(r.b)
        w[2] += r.same_ref
        w[3] += r.similarity is not None
    assert {(r.eval_split, r.eval_source): [r.pairs, r.eval_records, r.same_question, r.similar_query] for r in rows("p5_report")} == {k: [w[0], len(w[1]), w[2], w[3]] for k, w in want.items()}


def test_containers_hold_everything(spark, rows):
    load, size, pieces = Counter(), {}, Counter()
    for r in rows("p8_containers"):
        pieces[r.doc_id] += 1
        if r.container is not None:
            load[r.container] += r.tokens
            size[r.container] = r.container_length
        else:
            assert r.tokens == 0
    assert set(pieces) == {r.doc_id for r in read(spark, "documents").collect()}
    assert all(load[c] <= size[c] <= 16_384 for c in load)
    assert sum(load.values()) / sum(size.values()) > 0.97
    assert {k for k, n in pieces.items() if n > 1} == {r.doc_id for r in rows("p8_found")}


def test_mixture_keeps_its_caps(spark, rows):
    most = {r.source: r.max_repeats for r in read(spark, "mix_targets").collect()}
    from corvane.llm.mixing import source_name

    names = {r.n: most[r.source] for r in read(spark, "mix_targets").withColumn("n", source_name(F.col("source"))).collect()}
    assert all(1 <= r.copies <= names[r.source] for r in rows("p9_mixture"))
    used = Counter()
    for r in rows("p9_mixture"):
        used[r.source] += r.copies * r.tokens
    assert sum(used.values()) == sum(r.mixed_tokens for r in rows("p9_shares")) and abs(sum(r.actual_share for r in rows("p9_shares")) - 1) < 1e-9
    assert {r.source for r in rows("p9_found")} == {r.source for r in rows("p9_shares") if r.capped}
    free = [r for r in rows("p9_shares") if not r.capped and r.mixed_tokens < r.max_repeats * r.tokens]
    # what capped sources lack goes to the others in proportion; one source is mostly a few documents longer than its goal
    rate = sorted(r.actual_share / r.target_share for r in free)
    assert len(rate) > 10 and rate[-1] / rate[1] < 1.03 and rate[0] < rate[1]


def test_languages_have_confidences(rows):
    own = Counter(r.doc_id for r in rows("p10_languages") if r.segment is None)
    assert set(own.values()) == {1} and all(0 < r.confidence <= 1 and r.start <= r.end for r in rows("p10_languages"))
    spoken = defaultdict(set)
    for r in rows("p10_languages"):
        spoken[r.doc_id].add(r.language)
    assert all(r.found_lang in spoken[r.doc_id] for r in rows("p10_found"))
