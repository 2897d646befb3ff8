"""Queries of document ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmap.functions.text import HTML_RULES, passes_quality
from driftmap.operators import ingest as G
from driftmap.operators import keyed
from driftmap.operators import reports as R
from driftmap.plans import derived
from driftmap.plans.oracle import sql
from driftmap.plans.registry import query
from driftmap.session import shared_dir

SIZE, OVERLAP = 200, 20


def _sql_text(s: str) -> str:
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


def _html_sql(column: str) -> str:
    """The rules for sources with underlined headings: underscores stay, first headings are plain lines."""
    out = f"trim({column}, chr(32) || chr(9) || chr(10) || chr(13))"
    for pattern, to in HTML_RULES:
        to = {"\n\n# ": "\n\n"}.get(to, to)
        to = to.replace("$2", "\\2").replace("$1", "\\1")
        out = f"regexp_replace({out}, {_sql_text(pattern)}, {_sql_text(to)}, 'g')"
    return out


@query("ing1_exclude_documents", sql("""
    SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 2 = 1"""))
def ing1(spark, sf):
    docs = derived.table(spark, sf, "documents")
    named = docs.select("doc_id", F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"))
    listed = named.filter((F.col("doc_id") % 7 == 0) & (F.col("doc_id") % 2 == 0)).select(
        F.concat(F.lit("https://docs.example.org"), "url").alias("url")
    )
    return G.exclude(named, listed, "https://docs.example.org").select("doc_id")


@query("ing1_exclude_pages", sql("""
    SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 9 = 0)"""))
def ing1_pages(spark, sf):
    pages = derived.table(spark, sf, "pages").select("page_id", "url")
    return G.exclude(pages, pages.filter(F.col("page_id") % 9 == 0))


def unified(spark, sf):
    """Help articles, two community languages and marked-up pages, in one shape."""
    docs = derived.table(spark, sf, "documents")
    d = F.col("doc_id").cast("string")
    articles = G.as_document(
        docs, F.replace("text", F.lit("_"), F.lit("")), F.concat(F.lit("T"), d), F.concat(F.lit("/"), "source", F.lit("/"), d),
        F.array("source"), F.col("lang"),
    )
    talks = derived.table(spark, sf, "conversations").withColumn(
        "doc_id", F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    )

    def community(df, lang: str):
        return G.as_document(
            df, F.col("text"), F.concat(F.lit("Talk "), F.col("conv_id").cast("string")), F.concat(F.lit("/talk/"), "doc_id"),
            G.lower_tags(F.array(F.upper("role"), F.lit("Community"))), F.lit(lang),
        )

    pages = derived.table(spark, sf, "pages").withColumn("doc_id", F.concat(F.lit("p"), F.col("page_id").cast("string")))
    shop = G.as_document(
        pages, F.replace("html", F.lit("="), F.lit("")), F.concat(F.lit("Page "), F.col("page_id").cast("string")), F.col("url"),
        F.array(F.lit("shop")), F.regexp_extract("html", r'<html lang="(\w+)"', 1),
    )
    return G.unify(
        articles, community(talks.filter(F.col("conv_id") % 2 == 0), "en"),
        community(talks.filter(F.col("conv_id") % 2 == 1), "fr"), shop,
    )


UNIFIED = r"""
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, replace(text, '_', '') AS page_content, 'T' || doc_id AS page_title,
      '/' || source || '/' || doc_id AS source, source AS category, lang AS language FROM documents
    UNION ALL SELECT 'c' || conv_id || '-' || turn, text, 'Talk ' || conv_id, '/talk/c' || conv_id || '-' || turn,
      lower(role) || ',community', CASE WHEN conv_id % 2 = 0 THEN 'en' ELSE 'fr' END FROM conversations
    UNION ALL SELECT 'p' || page_id, replace(html, '=', ''), 'Page ' || page_id, url, 'shop',
      regexp_extract(html, '<html lang="(\w+)"', 1) FROM pages"""


@query("ing2_unify_sources", sql(UNIFIED))
def ing2(spark, sf):
    return unified(spark, sf).select(
        "doc_id", "page_content", "metadata.page_title", "metadata.source",
        F.array_join("metadata.category", ",").alias("category"), "metadata.language",
    )


@query("ing3_html_to_text", sql(f"""
    SELECT page_id, trim(replace({_html_sql("html")}, '=', ''), chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) AS page_content FROM pages"""))
def ing3(spark, sf):
    return G.pages_to_text(derived.table(spark, sf, "pages"), underlined=True).select("page_id", "page_content")


def sections(spark, sf):
    return G.split_headings(derived.headed_docs(spark, sf))


def chunks(spark, sf):
    return G.chunk(sections(spark, sf), "section_text", SIZE, OVERLAP)


def kept(spark, sf):
    return G.prefix_title(G.quality(chunks(spark, sf)), F.col("title"))


@query("ing4_heading_sections", sql("SELECT doc_id, title, lang, source, section, section_text FROM sections"))
def ing4(spark, sf):
    return sections(spark, sf)


@query("ing5_token_chunks", sql("SELECT doc_id, title, lang, source, section, chunk_no, content FROM chunks"))
def ing5(spark, sf):
    return chunks(spark, sf)


@query("ing5_default_windows", sql(r"""
    SELECT doc_id, CAST((s - 1) // 1100 AS INTEGER) AS chunk_no, array_to_string(list_slice(words, s, s + 1199), ' ') AS content
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 100 - 1, 0) + 2, 1100)) AS s FROM (
      SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS words FROM documents) WHERE len(words) > 0)"""))
def ing5_default(spark, sf):
    return G.chunk(derived.table(spark, sf, "documents").select("doc_id", "text"), "text")


@query("ing6_titled_chunks", sql("SELECT doc_id, title, lang, source, section, chunk_no, content FROM kept"))
def ing6(spark, sf):
    return kept(spark, sf)


@query("ing7_dedup_contents", sql("""
    SELECT sha256(content) AS content_key, content, count(*) AS copies, CAST(min(doc_id) AS BIGINT) AS first_doc, arg_max(lang, doc_id) AS lang,
      arg_max(source, doc_id) AS source
    FROM (SELECT doc_id, text AS content, lang, source FROM documents) GROUP BY content"""))
def ing7(spark, sf):
    docs = derived.table(spark, sf, "documents").withColumnRenamed("text", "content")
    return G.dedup(docs, ["doc_id"], ["lang", "source"]).select(
        "content_key", "content", "copies", F.col("first_pos.doc_id").alias("first_doc"), "lang", "source"
    )


@query("ing7_dedup_chunks", sql("""
    SELECT sha256(content) AS content_key, count(*) AS copies, min([doc_id, section, chunk_no])[1] AS first_doc,
      arg_max(title, [doc_id, section, chunk_no]) AS title FROM kept GROUP BY content"""))
def ing7_chunks(spark, sf):
    return G.dedup(kept(spark, sf), ["doc_id", "section", "chunk_no"], ["title"]).select(
        "content_key", "copies", F.col("first_pos.doc_id").alias("first_doc"), "title"
    )


def contents(spark, sf):
    return G.dedup(
        derived.table(spark, sf, "documents").withColumnRenamed("text", "content"), ["doc_id"], ["doc_id"]
    )


def cache(spark, sf):
    """Vectors of an earlier run: those of every second document that has one."""
    docs, vectors = derived.table(spark, sf, "documents"), derived.table(spark, sf, "embeddings")
    known = docs.filter(F.col("doc_id") % 2 == 0).join(vectors, F.col("doc_id") == F.col("vec_id"))
    return known.groupBy(G.content_key(F.col("text")).alias("content_key")).agg(
        F.max_by(F.struct("vec_id", "embedding"), "vec_id").alias("v")
    ).select("content_key", "v.vec_id", "v.embedding")


CACHE = """
    SELECT sha256(d.text) AS content_key, arg_max(v.embedding, v.vec_id) AS embedding, max(v.vec_id) AS vec_id
    FROM documents d JOIN embeddings v ON v.vec_id = d.doc_id WHERE d.doc_id % 2 = 0 GROUP BY 1"""


@query("ing8_cached_vectors", sql(f"""
    SELECT d.content_key, c.embedding
    FROM (SELECT DISTINCT sha256(text) AS content_key FROM documents) d LEFT JOIN ({CACHE}) c ON c.content_key = d.content_key"""))
def ing8(spark, sf):
    return G.reuse(contents(spark, sf), cache(spark, sf)).select("content_key", "embedding")


@query("ing9_new_contents", sql(f"""
    SELECT DISTINCT sha256(text) AS content_key, text AS content FROM documents
    WHERE sha256(text) NOT IN (SELECT content_key FROM ({CACHE}))"""))
def ing9(spark, sf):
    return G.to_embed(contents(spark, sf), cache(spark, sf)).select("content_key", "content")


@query("ing9_embed_counts", sql(f"""
    SELECT count(*) AS total, count(*) FILTER (content_key NOT IN (SELECT content_key FROM ({CACHE}))) AS "new"
    FROM (SELECT DISTINCT sha256(text) AS content_key FROM documents)"""))
def ing9_counts(spark, sf):
    return G.embed_counts(contents(spark, sf), cache(spark, sf))


@query("ing10_content_vector_pairs", sql(f"""
    SELECT d.content, c.embedding
    FROM (SELECT DISTINCT text AS content FROM documents) d JOIN ({CACHE}) c ON c.content_key = sha256(d.content)"""))
def ing10(spark, sf):
    return G.pairs(contents(spark, sf), cache(spark, sf)).select("content", "embedding")


def versions(spark, sf):
    """A version name per event: application, model and run time."""
    e = derived.table(spark, sf, "events")
    name = G.version_name(F.concat(F.lit("app"), (F.col("user_id") % 5).cast("string")), F.col("event_type"), at=F.col("ts"))
    return e.select("event_id", "user_id", "event_type", name.alias("version"))


VERSIONS = "SELECT event_id, user_id, event_type, 'app' || (user_id % 5) || '-' || event_type || '-' || strftime(ts, '%Y-%m-%d-%H-%M-%S') AS version FROM events"


@query("ing11_version_names", sql(f"SELECT event_id, version FROM ({VERSIONS})"))
def ing11(spark, sf):
    return versions(spark, sf).select("event_id", "version")


@query("ing12_stale_versions", sql(f"""
    SELECT event_id, version FROM ({VERSIONS}) WHERE starts_with(version, 'app1-click')
      AND version NOT IN (SELECT version FROM ({VERSIONS}) WHERE event_id % 10 = 0)"""))
def ing12(spark, sf):
    v = versions(spark, sf)
    return G.stale_versions(v, F.lit("app1-click"), v.filter(F.col("event_id") % 10 == 0)).select("event_id", "version")


@query("ing13_publish", sql("SELECT doc_id, lang, n_chars FROM documents"))
def ing13(spark, sf):
    base = shared_dir(spark, "publish")
    docs = derived.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    G.publish(docs.filter(F.col("doc_id") % 2 == 0), base, "docs_live", "v-2024-01-01")
    G.publish(docs, base, "docs_live", "v-2024-01-02")
    return G.current_version(spark, base, "docs_live")


MERGED = sql("""
    WITH latest AS (SELECT m.k, CASE WHEN e.event_id % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op, e.value AS v, e.event_type AS t
      FROM (SELECT event_id // 7 AS k, max(event_id) AS event_id FROM events GROUP BY 1) m
      JOIN events e ON e.event_id = m.event_id)
    SELECT coalesce(x.p_partkey, l.k) AS p_partkey, CASE WHEN l.k IS NULL THEN x.p_retailprice ELSE l.v END AS price,
      CASE WHEN l.k IS NULL THEN x.p_name ELSE l.t END AS name
    FROM (SELECT * FROM part WHERE p_partkey % 4 <> 0) x FULL JOIN latest l ON l.k = x.p_partkey
    WHERE l.k IS NULL OR l.op <> 'delete'""")


def merge_inputs(spark, sf):
    """(target, changes) of the keyed merge."""
    part = derived.table(spark, sf, "part")
    target = part.filter(F.col("p_partkey") % 4 != 0).select(
        "p_partkey", F.col("p_retailprice").alias("price"), F.col("p_name").alias("name")
    )
    e = F.col("event_id")
    changes = derived.table(spark, sf, "events").select(
        F.floor(e / 7).alias("p_partkey"), "event_id", F.col("value").alias("price"), F.col("event_type").alias("name"),
        F.when(e % 5 == 0, "delete").otherwise("upsert").alias("op"),
    )
    return target, changes


@query("ing14_keyed_merge", MERGED)
def ing14(spark, sf):
    return G.merge(*merge_inputs(spark, sf), "p_partkey", ["price", "name"], ["event_id"])


@query("ing14_bucketed_merge", MERGED)
def ing14_bucketed(spark, sf):
    """The changes reach a table in buckets in two batches, the second of them twice."""
    base = shared_dir(spark, "merged")
    target, changes = merge_inputs(spark, sf)
    keyed.create(target, base, "p_partkey", 16)
    half = changes.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    late = F.coalesce(F.col("event_id") > half, F.lit(False))
    for batch, rows in ((0, changes.where(~late)), (1, changes.where(late)), (1, changes.where(late))):
        G.merge_into(spark, base, rows, ["price", "name"], ["event_id"], ("changes", batch))
    return keyed.read(spark, base)


@query("ing15_preprocess_records", sql(r"""
    SELECT sha256(lower(regexp_replace(trim(text, chr(32) || chr(10)), '\s+', ' ', 'g'))) AS record_key,
      min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(n_chars, doc_id) AS n_chars
    FROM documents GROUP BY 1"""))
def ing15(spark, sf):
    docs = derived.table(spark, sf, "documents")
    return G.preprocess(docs, F.sha2(G.normalised(F.col("text")), 256), ["doc_id"], ["doc_id", "lang", "n_chars"])


STAGE_COUNTS = sql(f"""
    SELECT 'docs' AS stage, count(*) AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM chunks
    UNION ALL SELECT 'kept', count(*) FROM kept
    UNION ALL SELECT 'new', count(DISTINCT text) FROM documents WHERE sha256(text) NOT IN (SELECT content_key FROM ({CACHE}))""")


@query("agg11_run_counters", STAGE_COUNTS)
def agg11_run(spark, sf):
    """The counters of an ingestion run that writes its chunks and the contents to embed."""
    base, counters = shared_dir(spark, "counted"), {}
    docs = R.observed(derived.headed_docs(spark, sf), "docs", counters)
    pieces = R.observed(G.chunk(G.split_headings(docs), "section_text", SIZE, OVERLAP), "chunks", counters)
    G.prefix_title(R.observed(G.quality(pieces), "kept", counters), F.col("title")).write.parquet(f"{base}/chunks")
    R.observed(G.to_embed(contents(spark, sf), cache(spark, sf)), "new", counters).write.parquet(f"{base}/new")
    return R.run_counts(spark, counters)


@query("agg11_stage_counts", STAGE_COUNTS)
def agg11(spark, sf):
    fresh = G.to_embed(contents(spark, sf), cache(spark, sf))
    keeps = passes_quality(F.col("content"))
    return R.stage_counts(derived.table(spark, sf, "documents"), chunks(spark, sf), keeps, fresh)
