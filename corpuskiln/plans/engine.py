"""The engine: questions in, ranked passages, labels or answers out, all as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskiln.functions import legal as G
from corpuskiln.functions import rules as U
from corpuskiln.functions import text as X
from corpuskiln.operators import answer as A
from corpuskiln.operators import lookup as K
from corpuskiln.operators import providers as P
from corpuskiln.operators import ranks as R
from corpuskiln.operators import search as S
from corpuskiln.operators import store, structure
from corpuskiln.operators.textindex import TextIndex
from corpuskiln.operators.vectorindex import CellIndex
from corpuskiln.plans import ingest as I
from corpuskiln.sources.buckets import Buckets
from corpuskiln.sources.tables import written


class Engine:
    """``chunks``: chunk_id, document_id, doc_number, document_title, article_number, text, embedding."""

    def __init__(self, spark: SparkSession, chunks: DataFrame, embedder: P.Embedder | None = None, rules: dict | None = None, tables: dict[str, DataFrame] | None = None, cells: CellIndex | None = None):
        self.spark, self.chunks, self.rules = spark, chunks, rules or {"structural": [], "routing": {}, "overrides": []}
        self.embedder, self.tables, self.cells, self._words = embedder or P.HashedTokens(), tables or {}, cells, None

    @classmethod
    def ingest(cls, spark: SparkSession, path: str, at: str | None = None, **options) -> tuple[Engine, dict[str, DataFrame]]:
        """An engine over the files of a folder, and its tables. With ``at`` the tables are kept below it in buckets of
        documents, where files that were taken in before are replaced (``sources.buckets``)."""
        from corpuskiln.sources import files

        raw = files.files(spark, path)
        if at:
            store_ = Buckets(spark, at)
            I.ingested(raw, store_)
            tables = {name: store_.table(name) for name in store_.names()}
        else:
            tables = I.corpus_tables(raw)
            tables["chunk_vectors"] = written(tables["chunk_vectors"], name="chunk_vectors")
        return cls(spark, tables["chunk_vectors"], tables=tables, **options), tables

    @property
    def words(self) -> TextIndex:
        """The word index of the chunks with their documents' titles, written when it is first asked for."""
        if self._words is None:
            self._words = TextIndex.build(self.chunks, "chunk_id", "text", "document_title")
        return self._words

    def worded(self, queries: DataFrame, pool: DataFrame, n: int, filtered: bool) -> DataFrame:
        """(query_id, chunk_id, score, rank): full-text hits by cover density, and for questions without any the chunks that
        contain some of their longest words."""
        asked = queries.select("query_id", X.token_set(X.fold("query")).alias("terms"))
        full = self.words.ranked(asked, where=pool.select("chunk_id") if filtered else None).withColumnRenamed("key", "chunk_id")
        full = written(R.top_k(full, "query_id", [F.col("score").desc(), F.col("chunk_id")], n), name="full")
        left = queries.join(full.select("query_id").distinct(), "query_id", "left_anti").withColumn("terms", X.like_terms("query"))
        said = S.keyword_scores(left.select("query_id", "terms"), pool.select("chunk_id", "text"), first=6000).select("query_id", "chunk_id", "score")
        said = R.top_k(said, "query_id", [F.col("score").desc(), F.col("chunk_id")], n)
        return R.union([full, said])

    def search(self, queries: DataFrame, k: int = 10, where: Column | None = None) -> DataFrame:
        """Vector and full-text rankings fused, reranked, diversified; ``where`` filters chunks before scoring. Vectors are
        compared exactly, or through ``cells`` where the engine was given an index of them."""
        pool = self.chunks.filter(where) if where is not None else self.chunks
        q = P.embedded(queries, "query", self.embedder)
        if self.cells is not None:
            near = self.cells.search(q.select("query_id", F.col("embedding").alias(self.cells.vector)), 3 * k, where)
        else:
            near = S.vector_top_k(q.select("query_id", "embedding"), pool, "chunk_id", 3 * k)
        said = self.worded(queries, pool, 3 * k, where is not None)
        fused = R.rrf([near.select("query_id", "chunk_id", "score", "rank"), said], ["chunk_id"]).filter(F.col("rank") <= max(4 * k, 12))
        rows = pool.join(fused.select("query_id", "chunk_id", "rrf_score", F.col("rank").alias("r0")), "chunk_id").join(queries, "query_id")
        rows = rows.withColumn("rerank_score", P.overlap_rerank(F.col("query"), F.col("text")))
        top = R.top_k(rows, "query_id", [F.col("rerank_score").desc(), F.col("r0")], k)
        return R.diversified(top, "document_id").drop("rank", "r0", "embedding").withColumnRenamed("new_rank", "rank")

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """Passages of every question by one plan: what it names is looked up; a question that wants several articles and got
        one goes on, like those that name nothing, to ``search``; passages of amending documents bring the whole document."""
        if not self.tables:
            return self.search(queries, k).withColumn("way", F.lit("search"))
        flags = G.question_flags(F.col("query"))
        asked = queries.withColumn("_several", flags["wants_several"] & ~flags["names_article"])
        found = self.lookup(queries)
        articles = found.groupBy("query_id").agg(F.count_distinct("article_id").alias("_n"))
        settled = asked.join(articles, "query_id").filter(~F.col("_several") | (F.col("_n") > 1)).select("query_id", "query")
        titles = self.tables["documents"].select("document_id", F.col("title").alias("document_title"))
        named = found.join(settled, "query_id").join(titles, "document_id").withColumn("rerank_score", F.col("score")).withColumn("way", F.lit("lookup"))
        rest = written(queries.join(settled.select("query_id"), "query_id", "left_anti"), name="rest")
        said = self.search(rest, k)
        whole = K.amendments_expanded(said, self.tables["documents"], self.chunks.drop("embedding"))
        return R.union([named, whole.join(rest, "query_id").withColumn("way", F.lit("search"))])

    def search_widened(self, queries: DataFrame, where: Column, k: int = 10, least: int = 3) -> DataFrame:
        """``search`` among filtered chunks; questions that find fewer than ``least`` there get unfiltered hits behind them."""
        near = self.search(queries, k, where)
        few = queries.join(near.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").filter(F.coalesce("n", F.lit(0)) < least).drop("n")
        ids = S.topped_up([near, self.search(few, k)], k, "chunk_id", least)
        return ids.join(self.chunks.drop("embedding"), "chunk_id").join(queries, "query_id")

    def search_variants(self, queries: DataFrame, variants: DataFrame, k: int = 5) -> DataFrame:
        """``search``, topped up from the questions' variants (query_id, variant, query) where it finds fewer than k."""
        lists = [self.search(queries, k)] + [self.search(variants.filter(F.col("variant") == i).select("query_id", "query"), k) for i in (1, 2, 3)]
        ids = S.topped_up(lists, k, "chunk_id")
        return ids.join(self.chunks.drop("embedding"), "chunk_id").join(queries, "query_id")

    def classify(self, queries: DataFrame) -> DataFrame:
        """Structural label and confidence, and the routing groups whose patterns match."""
        hit = U.first_match(F.col("query"), self.rules["structural"])
        groups = [F.when(U.matches(F.col("query"), p), F.lit(g)) for g, p in self.rules["routing"].items()]
        routed = F.array_compact(F.array(*groups)) if groups else F.array().cast("array<string>")
        return queries.withColumn("_m", hit).select("query_id", "query", F.col("_m.label").alias("intent"), F.coalesce("_m.confidence", F.lit(0.3)).alias("confidence"), routed.alias("routes"))

    def answer(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """Context, sources and an extractive answer per query; a query without passages gets none."""
        found = written(self.retrieve(queries, k).drop("query"), name="found")
        context = A.grouped_context(found)
        cited = A.citations(A.sources(found).select("query_id", "doc_number", "article_number", "rank"))
        mean = found.groupBy("query_id").agg(F.avg("rerank_score").alias("mean"))
        text = P.extractive_answer(found.select("query_id", "rank", "text"))
        out = queries.join(text, "query_id", "left").join(context, "query_id", "left").join(cited, "query_id", "left").join(mean, "query_id", "left")
        return out.withColumn("confidence", A.confidence(F.coalesce("mean", F.lit(0.0)), F.coalesce("answer", F.lit("")), ["Điều", "Khoản"])).drop("mean")

    def lookup(self, queries: DataFrame) -> DataFrame:
        """Passages for questions that name an article, a number or a law; needs the corpus tables of ``ingest``."""
        return K.lookup(queries, self.tables["documents"], self.tables["articles"], self.tables["clauses"])

    def copilot(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, query, intent, route, answer, confidence): questions that name what they want are answered by lookup,
        those outside the field (rules: scope) are declined, all others by ``answer``."""
        seen = self.classify(queries)
        scope = self.rules.get("scope")
        allowed = U.in_scope(F.col("query"), scope["strong"], scope["blocked"]) if scope else F.lit(True)
        asked = queries.withColumn("_ok", allowed)
        direct = A.P.extractive_answer(self.lookup(queries)).withColumn("route", F.lit("lookup")) if self.tables else None
        said = self.answer(asked.filter("_ok").drop("_ok"), k).select("query_id", F.col("answer").alias("said"), "confidence")
        out = asked.join(said, "query_id", "left")
        out = out.join(direct.select("query_id", F.col("answer").alias("found"), "route"), "query_id", "left") if direct is not None else out.withColumns({"found": F.lit(None).cast("string"), "route": F.lit(None).cast("string")})
        text = F.when(~F.col("_ok"), A.NO_INFO).otherwise(F.coalesce("found", "said", F.lit(A.NO_INFO)))
        route = F.when(~F.col("_ok"), "declined").otherwise(F.coalesce("route", F.lit("search")))
        rows = out.select("query_id", A.with_heading(text).alias("answer"), route.alias("route"), "confidence")
        return seen.select("query_id", "query", "intent").join(rows, "query_id")

    def summarise(self, queries: DataFrame, budget: int = 22_000) -> DataFrame:
        """(query_id, document_id, summary): the first articles of each question's best document that fit the budget."""
        best = K.best_document(queries, self.tables["documents"])
        rows = best.join(self.tables["articles"], "document_id").withColumn("line", F.concat_ws("\n", F.concat_ws(". ", "article_number", F.nullif("title", F.lit(""))), "content"))
        kept = R.budget_prefix(rows, "query_id", [F.col("article_ord")], F.length("line"), budget)
        lines = F.transform(F.sort_array(F.collect_list(F.struct("article_ord", "line"))), lambda x: x["line"])
        return kept.groupBy("query_id", "document_id").agg(F.array_join(lines, "\n\n").alias("summary"))

    def compare(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """(query_id, side, document_id, context): passages of the two documents that a question compares."""
        sides = K.compared_documents(queries, self.tables["documents"]).filter("document_id IS NOT NULL")
        rows = sides.join(self.chunks.select("document_id", "chunk_id", "text"), "document_id")
        top = R.top_k(rows, ["query_id", "side"], [F.col("chunk_id")], k)
        return top.groupBy("query_id", "side", "document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n---\n").alias("context"))

    def tool(self, name: str, queries: DataFrame) -> DataFrame:
        """summarize, extract (lookup), classify, compare or draft (a skeleton with the legal basis that search finds)."""
        if name == "draft":
            found = self.search(queries, 8)
            refs = found.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", A.source_label(F.col("doc_number"), F.col("document_title")).alias("l")))), lambda x: x["l"]).alias("refs"))
            return queries.join(refs, "query_id", "left").select("query_id", A.draft_basis(F.col("query"), F.coalesce("refs", F.array().cast("array<string>"))).alias("draft"))
        return {"summarize": self.summarise, "extract": self.lookup, "classify": self.classify, "compare": self.compare}[name](queries)

    @staticmethod
    def procedures(queries: DataFrame, table: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
        """Steps of each question's best procedure, or, with ``aliases``, which documents are still missing."""
        return A.document_check(queries, table, aliases) if aliases is not None else A.best_procedure(queries, table)

    def document(self, document_id: int) -> DataFrame:
        """A document's row with its chapters, articles and chunks counted."""
        count = lambda t: self.tables[t].filter(F.col("document_id") == document_id).agg(F.count("*").alias(f"n_{t}"))
        return self.tables["documents"].filter(F.col("document_id") == document_id).crossJoin(count("chapters")).crossJoin(count("articles")).crossJoin(count("chunk_vectors"))

    def delete(self, ids: DataFrame) -> Engine:
        left = store.delete_cascade({"c": self.chunks, **self.tables}, ids)
        return Engine(self.spark, left.pop("c"), self.embedder, self.rules, left)

    def documents(self, offset: int = 0, limit: int = 20) -> DataFrame:
        return self.chunks.groupBy("document_id", "doc_number").agg(F.count("*").alias("n_chunks")).orderBy("document_id").offset(offset).limit(limit)

    def report(self, path: str, rows: int = 50) -> str:
        """What the corpus holds: documents by kind, articles and chunks by document, as JSON below ``path`` and as Markdown."""
        docs, arts = self.tables["documents"], self.tables["articles"]
        kinds = docs.groupBy("document_type").agg(F.count("*").alias("n_documents"), F.min("issued_date").cast("string").alias("first"), F.max("issued_date").cast("string").alias("last")).orderBy("document_type")
        held = docs.select("document_id", "title").join(arts.groupBy("document_id").agg(F.count("*").alias("n_articles")), "document_id", "left").join(structure.chunk_metrics(self.chunks), "document_id", "left").orderBy("document_id")
        return store.report({"kinds": kinds, "documents": held}, path, rows)

    def conversation(self, conversations: DataFrame, messages: DataFrame, said: DataFrame, keep: int = 100) -> tuple[DataFrame, DataFrame]:
        """Conversations and messages after ``said`` (conversation_id, message_id, role, text): the newest messages stay, and
        documents that are named in them are remembered."""
        numbers = X.references(F.col("text"))
        named = said.select("conversation_id", F.col("message_id").alias("at"), F.explode(numbers).alias("document"))
        return store.remembered(conversations, named), store.add_messages(messages, said, keep)

    def health(self) -> dict:
        return {"spark": self.spark.version, "chunks": self.chunks.count()}
