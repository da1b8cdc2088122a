"""Queries on chunking, indexing, search and the quality of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import heaps, markdown, retrieval
from ..session import scratch_path, table
from ..sources import readers, sinks

# The same class as functions.text.BLANKS, for the SQL engine's regular expressions.
_B = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.chunk_windows(table(spark, d, "documents"), "doc_id", "text")


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.length("chunk") * 0.5
    return chunk_windows(spark, d).agg(F.count("*").alias("chunks"), F.min(tokens).alias("least"), F.max(tokens).alias("most"), F.round(F.avg(tokens), 6).alias("mean"))


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without re-delivered rows. Texts multiply into terms, so the shuffle that tells repeated rows, by key alone,
    keeps all its partitions instead of being joined by its size."""
    return table(spark, d, "chunks").select("chunk_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk_id").distinct()


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: prompts whose id is divisible by 100."""
    return table(spark, d, "prompt_records").filter("case_id % 100 = 0").select("case_id", "query").distinct()


def index_terms(spark: SparkSession, d: str) -> DataFrame:
    """Document and corpus frequency of every term of the postings index."""
    return retrieval.term_counts(_corpus(spark, d), "chunk_id", "text")


def bm25_top5(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.lexical_top_k(_questions(spark, d), "case_id", "query", _corpus(spark, d), "chunk_id", "text", 5)


def context_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts with their retrieved passages in order of rank."""
    sources = table(spark, d, "chunks").select("chunk_id", "source").distinct()
    hits = bm25_top5(spark, d).join(_corpus(spark, d), "chunk_id").join(sources, "chunk_id").join(_questions(spark, d), "case_id")
    return markdown.context_prompt(hits, "case_id", "query", "rank", "source", "text").select("case_id", "prompt")


def phrase_searches(spark: SparkSession, d: str) -> DataFrame:
    """The five best chunks for single words that the index holds as several terms, searched in a stored index."""
    path = scratch_path(spark, "lexical-index")
    sinks.write_lexical_index(_corpus(spark, d), "chunk_id", "text", path, 8)
    words = ["گل\u200cبرگ", "می\u200cرود", "هم\u200cسفر است", "بچّه", "the story was", "!", "کنار"]
    queries = spark.createDataFrame(list(enumerate(words)), "query_no int, words string")
    return retrieval.search(queries, "query_no", "words", readers.lexical_index(spark, path), "chunk_id", 5)


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings")
    return v.filter("vec_id % 100 = 0"), v


def dense_top5(spark: SparkSession, d: str) -> DataFrame:
    q, v = _vectors(spark, d)
    return retrieval.dense_top_k(q, v, "vec_id", "embedding", 5)


def _judged(spark: SparkSession, d: str, pool: int = 20) -> DataFrame:
    """Synthetic grades of each query's candidate pool: ``pool`` rows of its label, picked by a fixed hash in a heap."""
    q, v = _vectors(spark, d)
    pairs = q.select(F.col("vec_id").alias("query_id"), "label").join(v.select(F.col("vec_id").alias("doc_id"), "label"), "label").filter("query_id != doc_id")
    entry = F.struct(((F.col("query_id") * 31 + F.col("doc_id") * 17) % 1009).alias("h"), "doc_id")
    picked = pairs.groupBy("query_id").agg(heaps.smallest(entry, pool).alias("p")).select("query_id", F.explode("p.doc_id").alias("doc_id"))
    return picked.select("query_id", "doc_id", (((F.col("query_id") * 7919 + F.col("doc_id") * 104729) % 1001) / 1000.0).alias("gain"))


def gold_index_quality(spark: SparkSession, d: str) -> DataFrame:
    """Each query's one right row is the next one by id."""
    q, v = _vectors(spark, d)
    gold = q.select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 1).alias("doc_id"))
    out = retrieval.gold_index_quality(q, gold, v, "vec_id", "embedding")
    return out.select("queries", *(F.round(c, 6).alias(c) for c in out.columns if c != "queries"))


def own_pool_quality(spark: SparkSession, d: str) -> DataFrame:
    """Scored hits ranked inside their own group by a hash that stands for a model's similarity."""
    r = table(spark, d, "retrieved_chunks").filter("score is not null and not isnan(score)").groupBy("question_ref", "persona_id", "chunk_id").agg(F.max("score").alias("score"))
    r = r.withColumn("sim", F.conv(F.substring(F.md5("chunk_id"), 1, 8), 16, 10).cast("long"))
    out = retrieval.own_pool_quality(r, ["question_ref", "persona_id"], "chunk_id", "score", "sim")
    return out.select("groups", *(F.round(c, 6).alias(c) for c in out.columns if c != "groups"))


def anchor_penalty(spark: SparkSession, d: str) -> DataFrame:
    """How far unit vectors have moved from those of the next row, which stand for what they were before training."""
    v = table(spark, d, "embeddings")
    a = v.select("vec_id", retrieval.unit(F.col("embedding")).alias("v"))
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), retrieval.unit(F.col("embedding")).alias("base"))
    return retrieval.anchor_penalty(a.join(b, "vec_id"), "v", "base").select(F.round("penalty", 6).alias("penalty"))


def ranking_quality(spark: SparkSession, d: str) -> DataFrame:
    q, v = _vectors(spark, d)
    ranked = retrieval.full_ranks(_judged(spark, d), q, v, "vec_id", "embedding")
    out = retrieval.ranking_quality(ranked)
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in out.columns if c != "query_id"))


def ranking_means(spark: SparkSession, d: str) -> DataFrame:
    """Means over all queries and per label, in one pass."""
    q, v = _vectors(spark, d)
    ranked = retrieval.full_ranks(_judged(spark, d), q, v, "vec_id", "embedding")
    per = retrieval.ranking_quality(ranked).join(v.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return per.rollup("label").agg(*(F.round(F.avg(c), 5).alias(c) for c in ("ndcg5", "hit5", "recall", "mrr", "judged")))


def training_losses(spark: SparkSession, d: str) -> DataFrame:
    """Contrastive and distillation losses of every query over the first eight judged rows by id."""
    q, v = _vectors(spark, d)
    j = _judged(spark, d).join(v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dv")), "doc_id").join(q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")), "query_id")
    w = Window.partitionBy("query_id").orderBy("doc_id")
    j = j.withColumn("n", F.row_number().over(w)).filter("n <= 8").withColumn("sim", retrieval.dot(F.col("qv"), F.col("dv")))
    listed = F.array_sort(F.collect_list(F.struct("n", "sim", "gain")))
    g = j.groupBy("query_id").agg(listed.alias("l"))
    sims, gains = F.transform("l", lambda x: x.sim), F.transform("l", lambda x: x.gain)
    return g.select("query_id", F.round(retrieval.mnrl_loss(sims, 0.05), 5).alias("mnrl"), F.round(retrieval.kd_loss(gains, sims, 0.25, 0.1), 5).alias("kd"))


def _graded(spark: SparkSession, d: str) -> DataFrame:
    """The grades of ``_judged`` for every row of the query's label, with similarities."""
    q, v = _vectors(spark, d)
    pairs = q.select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("qv")).join(v.select(F.col("vec_id").alias("doc_id"), "label", F.col("embedding").alias("dv")), "label").filter("query_id != doc_id")
    gain = ((F.col("query_id") * 7919 + F.col("doc_id") * 104729) % 1001) / 1000.0
    return pairs.select("query_id", "doc_id", gain.alias("gain"), retrieval.dot(F.col("qv"), F.col("dv")).alias("sim"))


def _whole_quality(spark: SparkSession, d: str) -> DataFrame:
    q, v = _vectors(spark, d)
    return retrieval.ranking_quality(retrieval.deciding_ranks(_graded(spark, d).drop("sim"), q, v, "vec_id", "embedding"))


def ranking_quality_whole(spark: SparkSession, d: str) -> DataFrame:
    """``ranking_quality`` with every row of the query's label graded."""
    out = _whole_quality(spark, d)
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in out.columns if c != "query_id"))


def ranking_means_whole(spark: SparkSession, d: str) -> DataFrame:
    """``ranking_means`` with every row of the query's label graded."""
    q, _ = _vectors(spark, d)
    per = _whole_quality(spark, d).join(q.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return per.rollup("label").agg(*(F.round(F.avg(c), 5).alias(c) for c in ("ndcg5", "hit5", "recall", "mrr", "judged")))


def training_losses_whole(spark: SparkSession, d: str) -> DataFrame:
    """``training_losses`` over every row of the query's label, the smallest id being the positive one."""
    out = retrieval.whole_losses(_graded(spark, d), 0.05, 0.25, 0.1)
    return out.select("query_id", F.round("mnrl", 5).alias("mnrl"), F.round("kd", 5).alias("kd"))


def heading_blocks(spark: SparkSession, d: str) -> DataFrame:
    return markdown.heading_blocks(table(spark, d, "documents"), "doc_id", "text")


def lesson_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunk ids of heading blocks, with the lesson carried forward inside each document."""
    b = heading_blocks(spark, d).withColumn("source", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).withColumn("section", F.concat(F.lit("h"), F.col("level").cast("string")))
    return markdown.carry_lessons(b, "source", "block", "heading", "section").select("doc_id", "block", "lesson", "chunk_id")


def token_fidelity(spark: SparkSession, d: str) -> DataFrame:
    """Share of the query's content tokens that the chosen answer keeps."""
    p = table(spark, d, "dpo_pairs").select("pair_id", "query", "chosen").distinct()
    src, got = tx.content_tokens(F.col("query")), tx.content_tokens(F.coalesce("chosen", F.lit("")))
    return p.select("pair_id", F.round(F.size(F.array_intersect(src, got)) / F.nullif(F.size(src), F.lit(0)), 6).alias("fidelity"))


def repeated_trigrams(spark: SparkSession, d: str) -> DataFrame:
    """Share of texts in which three consecutive words occur twice, per section type."""
    t = table(spark, d, "chunks").select("chunk_id", "section_type", "text").distinct()
    return t.groupBy("section_type").agg(F.count("*").alias("n"), F.round(F.avg(tx.has_repeated_trigram(F.col("text")).cast("double")), 6).alias("rate"))


QUERIES = {
    f.__name__: f
    for f in (chunk_windows, chunk_stats, index_terms, bm25_top5, phrase_searches, gold_index_quality, own_pool_quality, anchor_penalty, context_prompts, dense_top5, ranking_quality, ranking_means, training_losses, ranking_quality_whole, ranking_means_whole, training_losses_whole, heading_blocks, lesson_chunks, token_fidelity, repeated_trigrams)
}

_WINDOWS = f"""
with w as (
  select doc_id, s, regexp_replace(substring(text, s + 1, 800), '^[{_B}]+|[{_B}]+$', '', 'g') as chunk
  from (select doc_id, text, unnest(range(0, length(text), 650)) as s from documents where length(text) > 0)
)
"""
# The normalised form and the terms of ``functions.text``.
_NORM = lambda c: f"regexp_replace(regexp_replace(translate(translate({c}, 'يك', 'یک'), '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), '[{_B}]+', ' ', 'g'), '^[{_B}]+|[{_B}]+$', '', 'g')"
_SPLIT = lambda c: f"list_filter(regexp_split_to_array(regexp_replace(translate(lower({c}), '{tx.ACCENTED}', '{tx.PLAIN}'), '[\\x{{300}}-\\x{{331}}]', '', 'g'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x != '')"
_TERMS = f"""
with corpus as (select distinct chunk_id, text from chunks),
 doc as (select chunk_id, {_SPLIT(_NORM('text'))} as ts from corpus),
 toks as (select chunk_id, unnest(ts) as term, generate_subscripts(ts, 1) as place from doc),
 tf as (select chunk_id, term, count(*) as tf from toks group by 1, 2)
"""
_BM25 = (
    _TERMS
    + f""",
 len as (select chunk_id, len(ts) as len from doc where len(ts) > 0),
 tot as (select count(*) as docs, avg(len) as mean from len),
 qs as (select distinct case_id, query from prompt_records where case_id % 100 = 0),
 qt as (select case_id, {_SPLIT('w')} as phrase, count(*) as qf from (select case_id, unnest(string_split({_NORM('query')}, ' ')) as w from qs) where len({_SPLIT('w')}) > 0 group by 1, 2),
 ph as (select distinct phrase from qt),
 hits as (select phrase, chunk_id, count(*) as tf from ph join toks on term = phrase[1] join doc using (chunk_id) where ts[place:place + len(phrase) - 1] = phrase group by 1, 2),
 dfs as (select phrase, count(*) as df from hits group by 1),
 sc as (
  select case_id, chunk_id, round(sum(qf * greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) as score
  from qt join dfs using (phrase) join hits using (phrase) join len using (chunk_id) cross join tot group by 1, 2),
 top as (select *, row_number() over (partition by case_id order by score desc, chunk_id) as rank from sc qualify rank <= 5)
"""
)
_SIMS = """
with q as (select vec_id as query_id, label as ql, cast(embedding as double[]) as qv from embeddings where vec_id % 100 = 0),
 v as (select vec_id as doc_id, label as dl, cast(embedding as double[]) as dv from embeddings),
 sims as (select query_id, doc_id, ql, dl, round(list_dot_product(qv, dv), 6) as sim, list_dot_product(qv, dv) as raw from q cross join v),
 ranks as (select *, row_number() over (partition by query_id order by sim desc, doc_id) as rank from sims where query_id != doc_id),
 judged as (select *, ((query_id * 7919 + doc_id * 104729) % 1001) / 1000.0 as gain from (select *, row_number() over (partition by query_id order by (query_id * 31 + doc_id * 17) % 1009, doc_id) as pick from ranks where ql = dl) where pick <= 20),
 ideal as (select *, row_number() over (partition by query_id order by gain desc, doc_id) as ideal from judged),
 per as (
  select query_id, any_value(ql) as label, {cols},
   sum(case when ideal <= 3 and rank <= 5 then 1.0 else 0.0 end) / sum(case when ideal <= 3 then 1.0 else 0.0 end) as recall,
   coalesce(max(case when ideal <= 3 then 1.0 / rank end), 0.0) as mrr,
   sum(case when rank <= 5 then 1.0 else 0.0 end) / 5 as judged
  from ideal group by query_id)
""".replace(
    "{cols}",
    ", ".join(
        f"coalesce(sum(case when rank <= {i} then gain / log2(rank + 1.0) else 0.0 end) / nullif(sum(case when ideal <= {i} then gain / log2(ideal + 1.0) else 0.0 end), 0), 0.0) as ndcg{i}, max(case when ideal <= 3 and rank <= {i} then 1.0 else 0.0 end) as hit{i}"
        for i in range(1, 6)
    ),
)
_PER = ", ".join(f"round({c}, 6) as {c}" for i in range(1, 6) for c in (f"ndcg{i}", f"hit{i}")) + ", round(recall, 6) as recall, round(mrr, 6) as mrr, round(judged, 6) as judged"
_CONTENT = "list_distinct(regexp_extract_all(coalesce({}, ''), '[\\x{{600}}-\\x{{6FF}}\\x{{200c}}]{{3,}}'))"
_SRC, _GOT = _CONTENT.format("query"), _CONTENT.format("chosen")

_HEADINGS = f"""
with t as (select doc_id, string_split(text, chr(10)) as ls from documents), l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from t),
 m as (select *, regexp_matches(line, '^#{{1,4}}[ \\t]+\\S') as h, sum(case when regexp_matches(line, '^#{{1,4}}[ \\t]+\\S') then 1 else 0 end) over (partition by doc_id order by i) as g from l),
 hb as (select doc_id, cast(g - 1 as integer) as block, max(case when h then length(regexp_extract(line, '^#+')) end) as level, max(case when h then regexp_replace(regexp_replace(line, '^#+', ''), '^[{_B}]+|[{_B}]+$', '', 'g') end) as heading,
   regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) order by i) filter (where not h), ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[{_B}]+|[{_B}]+$', '', 'g') as body from m where g > 0 group by doc_id, g)
"""
_WORD = "regexp_replace(regexp_extract(heading, 'درس\\s+(\\S+)', 1), '[:،]+$', '')"
_ORDINALS = "['یکم', 'اول', 'دوم', 'سوم', 'چهارم', 'پنجم', 'ششم', 'هفتم', 'هشتم', 'نهم', 'دهم', 'یازدهم', 'دوازدهم', 'سیزدهم', 'چهاردهم', 'پانزدهم', 'شانزدهم', 'هفدهم']"

ORACLE = {
    "heading_blocks": _HEADINGS + "select doc_id, block, level, heading, body from hb",
    "lesson_chunks": _HEADINGS
    + f""", n as (select *, coalesce(try_cast(translate(regexp_extract(heading, 'درس\\s+([۰-۹]+)', 1), '۰۱۲۳۴۵۶۷۸۹', '0123456789') as integer), case when list_position({_ORDINALS}, {_WORD}) > 0 then greatest(1, list_position({_ORDINALS}, {_WORD}) - 1) end) as no from hb),
 c as (select *, coalesce(last_value(case when no is not null then printf('lesson-%02d', no) end ignore nulls) over (partition by doc_id order by block rows unbounded preceding), 'preamble') as lesson from n)
 select doc_id, block, lesson, printf('d%d:%s:h%d:%03d', doc_id, lesson, level, row_number() over (partition by doc_id, lesson, level order by block)) as chunk_id from c""",
    "chunk_windows": _WINDOWS + "select doc_id, cast(row_number() over (partition by doc_id order by s) - 1 as integer) as idx, chunk from w where chunk != ''",
    "chunk_stats": _WINDOWS + "select count(*) as chunks, cast(min(length(chunk) * 0.5) as double) as least, cast(max(length(chunk) * 0.5) as double) as most, round(cast(avg(length(chunk) * 0.5) as double), 6) as mean from w where chunk != ''",
    "index_terms": _TERMS + "select term, count(*) as df, cast(sum(tf) as bigint) as ctf from tf group by 1",
    "bm25_top5": _BM25 + "select case_id, chunk_id, score, cast(rank as integer) as rank from top",
    "context_prompts": _BM25
    + """select case_id, string_agg('[' || rank || '] (source: ' || source || ') ' || text, chr(10) order by rank) || chr(10) || chr(10) || 'Question: ' || any_value(query) as prompt
  from top join corpus using (chunk_id) join (select distinct chunk_id, source from chunks) using (chunk_id) join qs using (case_id) group by case_id""",
    "phrase_searches": _BM25.replace("select distinct case_id, query from prompt_records where case_id % 100 = 0", "select i as case_id, w as query from (values (0, 'گل\u200cبرگ'), (1, 'می\u200cرود'), (2, 'هم\u200cسفر است'), (3, 'بچّه'), (4, 'the story was'), (5, '!'), (6, 'کنار')) t(i, w)")
    + "select case_id as query_no, chunk_id, score, cast(rank as integer) as rank from top",
    "gold_index_quality": """
 with q as (select vec_id as query_id, cast(embedding as double[]) as qv from embeddings where vec_id % 100 = 0), v as (select vec_id as doc_id, cast(embedding as double[]) as dv from embeddings),
 r as (select query_id, doc_id, row_number() over (partition by query_id order by round(list_dot_product(qv, dv), 6) desc, doc_id) as rank from q cross join v where query_id != doc_id)
 select count(*) as queries, """
    + ", ".join(f"round(avg(case when rank <= {i} then 1.0 else 0.0 end), 6) as recall{i}" for i in range(1, 6))
    + ", round(avg(1.0 / rank), 6) as mrr from r where doc_id = query_id + 1",
    "own_pool_quality": """
 with sc as (select question_ref, persona_id, chunk_id, max(score) as score from retrieved_chunks where score is not null and not isnan(score) group by 1, 2, 3),
 r as (select *, count(*) over g as n, max(score) over g as best, row_number() over (partition by question_ref, persona_id order by cast('0x' || substring(md5(chunk_id), 1, 8) as bigint) desc, chunk_id) as rank, row_number() over (partition by question_ref, persona_id order by score desc, chunk_id) as ideal from sc window g as (partition by question_ref, persona_id)),
 p as (select min(case when best - score < 1e-6 then rank end) as first, sum(case when rank <= 5 then score / log2(rank + 1.0) else 0.0 end) as dcg, sum(case when ideal <= 5 then score / log2(ideal + 1.0) else 0.0 end) as idcg from r where n >= 2 group by question_ref, persona_id)
 select count(*) as groups, """
    + ", ".join(f"round(avg(case when first <= {i} then 1.0 else 0.0 end), 6) as recall{i}" for i in range(1, 6))
    + ", round(avg(case when idcg > 0 then dcg / idcg else 0.0 end), 6) as ndcg5 from p",
    "anchor_penalty": """
 with v as (select vec_id, cast(embedding as double[]) as e from embeddings) select round(avg(1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))), 6) as penalty from v a join v b on b.vec_id = a.vec_id + 1""",
    "dense_top5": """
 select query_id, doc_id, score, cast(rank as integer) as rank from (
  select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from (
   select q.vec_id as query_id, v.vec_id as doc_id, round(list_dot_product(cast(q.embedding as double[]), cast(v.embedding as double[])), 6) as score
   from embeddings q cross join embeddings v where q.vec_id % 100 = 0)) where rank <= 5""",
    "ranking_quality": _SIMS + f"select query_id, {_PER} from per",
    "ranking_means": _SIMS + "select label, round(avg(ndcg5), 5) as ndcg5, round(avg(hit5), 5) as hit5, round(avg(recall), 5) as recall, round(avg(mrr), 5) as mrr, round(avg(judged), 5) as judged from per group by rollup (label)",
    "training_losses": _SIMS
    + """, f as (select *, row_number() over (partition by query_id order by doc_id) as n from judged qualify n <= 8),
 z as (select query_id, max(raw) as top, max(gain) as gtop, max(case when n = 1 then raw end) as pos from f group by 1),
 s as (select query_id, ln(sum(exp((raw - top) / 0.05))) + any_value(top) / 0.05 - any_value(pos) / 0.05 as mnrl, ln(sum(exp((raw - top) / 0.1))) + any_value(top) / 0.1 as ls, ln(sum(exp((gain - gtop) / 0.25))) + any_value(gtop) / 0.25 as lt from f join z using (query_id) group by 1)
 select query_id, round(any_value(mnrl), 5) as mnrl, round(sum(exp(gain / 0.25 - lt) * ((gain / 0.25 - lt) - (raw / 0.1 - ls))), 5) as kd from f join s using (query_id) group by query_id""",
    "token_fidelity": f"select pair_id, round(len(list_intersect({_SRC}, {_GOT})) / nullif(len({_SRC}), 0), 6) as fidelity from (select distinct pair_id, query, chosen from dpo_pairs)",
    "repeated_trigrams": f"""
 with t as (select distinct chunk_id, section_type, text from chunks),
  w as (select chunk_id, section_type, list_filter(regexp_split_to_array(text, '[{_B}]+'), lambda x: x != '') as ws from t),
  g as (select chunk_id, unnest(range(1, greatest(len(ws) - 1, 1))) as i, ws from w),
  r as (select chunk_id, count(*) as n, count(distinct list_aggregate(ws[i:i + 2], 'string_agg', ' ')) as k from g group by 1)
 select section_type, count(*) as n, round(avg(case when coalesce(k, 0) < coalesce(r.n, 0) then 1.0 else 0.0 end), 6) as rate from w left join r using (chunk_id) group by 1""",
}
