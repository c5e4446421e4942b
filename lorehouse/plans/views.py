"""The corpus tables that the operators work on, derived from the given tables by Spark, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut

NOW = "2024-02-01"


class Views:
    """Tables of one folder, each read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._n, self._keys = spark, sf_dir, None, None

    def raw(self, table: str) -> DataFrame:
        """A table; documents of fewer splits than there are cores are dealt out by their id, as a small file may be a single row group."""
        df = self.spark.read.parquet(f"{self.dir}/{table}.parquet")
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores, "doc_id") if table == "documents" and df.rdd.getNumPartitions() < cores else df

    def n_vectors(self) -> int:
        """Rows of embeddings, which Parquet's footers tell."""
        if self._n is None:
            self._n = max(1, self.raw("embeddings").count())
        return self._n

    def pages(self, **more: Column) -> DataFrame:
        """All pages; `more` are columns made of a document alone, before the join, which then moves a text only if it is asked for as well."""
        d, q = self.raw("documents").withColumns(more), self.raw("labels").select(F.col("doc_id").alias("l_id"), "quality")
        kind = F.when(F.col("quality") == 1, "concept").when(F.col("quality") == 0, "note")
        return d.join(q, F.col("doc_id") == F.col("l_id"), "left").select(
            F.col("doc_id").alias("page_id"), F.col("source").alias("source_id"), F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("slug"), kind.alias("type"),
            F.substring("text", 1, 40).alias("title"), F.col("text").alias("compiled_truth"), "n_chars",
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("updated_on"), (F.col("doc_id") % 97 == 0).alias("deleted"), *more,
        )

    def tags(self) -> DataFrame:
        d, l = self.raw("documents"), self.raw("labels")
        return (
            d.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("tag"))
            .unionByName(d.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("src:"), "source").alias("tag")))
            .unionByName(l.where(F.col("toxic") == 1).select(F.col("doc_id").alias("page_id"), F.lit("loss").alias("tag")))
        )

    def chunks(self) -> DataFrame:
        """The lines of all texts; ids are unique up to ten million lines a text."""
        lines = self.raw("documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "chunk_text"))
        return lines.where(F.trim("chunk_text") != "").select(
            (F.col("page_id") * 10_000_000 + F.col("chunk_index")).alias("chunk_id"), "page_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_text",
            F.when(F.col("chunk_index") == 0, "compiled_truth").otherwise("timeline").alias("chunk_source"), ((F.col("page_id") * 31 + F.col("chunk_index")) % self.n_vectors()).alias("vec_id"),
        )

    def chunk_keys(self) -> DataFrame:
        """The chunks without their texts, written once for these views: a row is some 40 bytes."""
        if self._keys is None:
            self._keys = cut(self.chunks().drop("chunk_text"))
        return self._keys

    def postings(self) -> DataFrame:
        return terms(self.chunks().select("chunk_id", "page_id", "chunk_text"), "chunk_text").groupBy("chunk_id", "page_id", "term").agg(F.count("*").alias("tf"))

    def edges(self) -> DataFrame:
        def of(table: str, a: str, ak: str, b: str, bk: str, kind: str) -> DataFrame:
            return self.raw(table).select(F.concat(F.lit(a + "/"), F.col(ak).cast("string")).alias("src"), F.concat(F.lit(b + "/"), F.col(bk).cast("string")).alias("dst"), F.lit(kind).alias("lt"))

        return (
            of("orders", "customer", "o_custkey", "order", "o_orderkey", "placed")
            .unionByName(of("lineitem", "order", "l_orderkey", "part", "l_partkey", "contains"))
            .unionByName(of("lineitem", "order", "l_orderkey", "supplier", "l_suppkey", "shipped_by"))
            .unionByName(of("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "located_in"))
            .unionByName(of("customer", "customer", "c_custkey", "nation", "c_nationkey", "located_in"))
            .unionByName(of("nation", "nation", "n_nationkey", "region", "n_regionkey", "part_of"))
        )

    def links(self) -> DataFrame:
        """Links between pages: each page to three others by arithmetic on its id, some of which don't exist."""
        p = self.raw("documents").select(F.col("doc_id").alias("from_page_id"))
        to = F.explode(F.array(F.col("from_page_id") * 7 % 1013, F.col("from_page_id") * 11 % 509, F.floor(F.col("from_page_id") / 3)).cast("array<bigint>"))
        kind = F.when(F.col("from_page_id") % 3 == 0, "mentions").when(F.col("from_page_id") % 3 == 1, "works_at").otherwise("founded")
        return p.select("from_page_id", to.alias("to_page_id"), kind.alias("link_type")).where(F.col("from_page_id") != F.col("to_page_id")).distinct()

    def facts(self) -> DataFrame:
        kind = F.create_map(*[F.lit(x) for x in ("signup", "event", "purchase", "commitment", "click", "preference", "view", "belief", "error", "fact")])
        return self.raw("events").select(
            F.col("event_id").alias("fact_id"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("entity_slug"), F.col("event_type").alias("claim_metric"), F.col("value").alias("claim_value"),
            F.col("ts").cast("timestamp_ntz").alias("valid_from"), (F.col("event_id") % self.n_vectors()).alias("vec_id"), kind[F.col("event_type")].alias("kind"), ((F.col("event_id") % 101) / 100.0).cast("double").alias("confidence"),
            (F.col("event_id") % 13 == 0).alias("expired"),
        )

    def takes(self) -> DataFrame:
        l, d = self.raw("labels"), self.raw("documents").select("doc_id", "source", F.split("text", "\n")[0].alias("claim"))
        quality = F.when(F.col("toxic") == 1, "partial").when(F.col("quality") == 1, "correct").otherwise("incorrect")
        return l.join(d, "doc_id").select(
            F.col("doc_id").alias("take_id"), F.col("doc_id").alias("page_id"), F.col("source").alias("holder"), F.lit("bet").alias("kind"), ((F.col("doc_id") * 37 % 101).cast("double") / 100.0).alias("weight"), quality.alias("resolved_quality"),
            (F.col("doc_id") % 5 != 0).alias("active"), "claim", (F.col("doc_id") % self.n_vectors()).alias("vec_id"),
        )

    def questions(self) -> DataFrame:
        return self.raw("benchmark").select(F.col("item_id").alias("query_id"), "text", (F.col("item_id") % self.n_vectors()).alias("vec_id"))

    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))

    def sessions(self) -> DataFrame:
        return self.raw("conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", "text")


def terms(df: DataFrame, column: str) -> DataFrame:
    """One row for each ASCII term of a column, which it replaces."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.regexp_extract_all(F.lower(column), F.lit("[a-z0-9]+"), 0)).alias("term"))


#: The same views for DuckDB; a query names those that it uses.
SQL = {
    "pages": """select d.doc_id as page_id, d.source as source_id, concat_ws('/', d.lang, d.source, cast(d.doc_id as varchar)) as slug,
       case when l.quality = 1 then 'concept' when l.quality = 0 then 'note' end as type, substring(d.text, 1, 40) as title, d.text as compiled_truth, d.n_chars,
       cast(date '2024-01-01' + cast(d.doc_id % 30 as int) as date) as updated_on, d.doc_id % 97 = 0 as deleted
  from documents d left join labels l on l.doc_id = d.doc_id""",
    "tags": """select doc_id as page_id, lang as tag from documents union all select doc_id, 'src:' || source from documents
  union all select doc_id, 'loss' from labels where toxic = 1""",
    "chunks": """select page_id * 10000000 + chunk_index as chunk_id, page_id, chunk_index, chunk_text,
       case when chunk_index = 0 then 'compiled_truth' else 'timeline' end as chunk_source, (page_id * 31 + chunk_index) % (select count(*) from embeddings) as vec_id
  from (select doc_id as page_id, generate_subscripts(parts, 1) - 1 as chunk_index, unnest(parts) as chunk_text
        from (select doc_id, string_split(text, chr(10)) as parts from documents)) where trim(chunk_text) <> ''""",
    "postings": """select chunk_id, page_id, term, count(*) as tf
  from (select chunk_id, page_id, unnest(regexp_extract_all(lower(chunk_text), '[a-z0-9]+')) as term from chunks) group by all""",
    "edges": """select 'customer/' || o_custkey as src, 'order/' || o_orderkey as dst, 'placed' as lt from orders
  union all select 'order/' || l_orderkey, 'part/' || l_partkey, 'contains' from lineitem
  union all select 'order/' || l_orderkey, 'supplier/' || l_suppkey, 'shipped_by' from lineitem
  union all select 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'located_in' from supplier
  union all select 'customer/' || c_custkey, 'nation/' || c_nationkey, 'located_in' from customer
  union all select 'nation/' || n_nationkey, 'region/' || n_regionkey, 'part_of' from nation""",
    "links": """select distinct f as from_page_id, t as to_page_id, case f % 3 when 0 then 'mentions' when 1 then 'works_at' else 'founded' end as link_type
  from (select doc_id as f, unnest([doc_id * 7 % 1013, doc_id * 11 % 509, doc_id // 3]) as t from documents) where f <> t""",
    "facts": """select event_id as fact_id, 'user/' || user_id as entity_slug, event_type as claim_metric, value as claim_value, ts as valid_from, event_id % (select count(*) from embeddings) as vec_id,
       case event_type when 'signup' then 'event' when 'purchase' then 'commitment' when 'click' then 'preference' when 'view' then 'belief' when 'error' then 'fact' end as kind,
       cast(event_id % 101 as double) / 100.0 as confidence, event_id % 13 = 0 as expired from events""",
    "takes": """select l.doc_id as take_id, l.doc_id as page_id, d.source as holder, 'bet' as kind, cast(l.doc_id * 37 % 101 as double) / 100.0 as weight,
       case when l.toxic = 1 then 'partial' when l.quality = 1 then 'correct' else 'incorrect' end as resolved_quality, l.doc_id % 5 <> 0 as active,
       string_split(d.text, chr(10))[1] as claim, l.doc_id % (select count(*) from embeddings) as vec_id
  from labels l join documents d on d.doc_id = l.doc_id""",
    "questions": "select item_id as query_id, text, item_id % (select count(*) from embeddings) as vec_id from benchmark",
    "vectors": "select vec_id, cast(embedding as double[]) as v from embeddings",
    "sessions": "select conv_id as session_id, turn, role, text from conversations",
}
_NEEDS = {"postings": ["chunks"]}


def sql(views: str, query: str) -> str:
    """query with the named views before it."""
    names: list[str] = []
    for v in views.split():
        for n in [*_NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    head = "with recursive " if "recursive" in query.split("select")[0] else "with "
    query = query.strip()
    views_sql = ",\n".join(f"{n} as ({SQL[n]})" for n in names)
    if query.startswith("with "):
        query = query[5:].removeprefix("recursive ")
        return f"{head}{views_sql},\n{query}" if names else f"{head}{query}"
    return f"{head}{views_sql}\n{query}" if names else query
