"""Test sets from documents: nodes, extracted properties, relations, personas, scenarios and samples."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import graph as graphs
from ..operators import pairs, splitters, testset
from ..operators.graph import Graph
from ..sources.shared import written
from .judging import Judge
from .model import embedded
from .prompts import Prompt

Step = Callable[[Graph], Graph]

PROMPTS: dict[str, Prompt] = {
    p.name: p
    for p in (
        Prompt("summary", "Summarise the text in a few sentences.", "text string"),
        Prompt("keyphrases", "List the text's keyphrases, {most} at most.", "keyphrases array<string>"),
        Prompt("title", "Give the text a title.", "text string"),
        Prompt("headlines", "List the headlines of the text as they stand in it, {most} at most.", "headlines array<string>"),
        Prompt("entities", "List the named entities of the text, {most} at most.", "entities array<string>"),
        Prompt("topic", "Describe the text's topic in a sentence.", "text string"),
        Prompt("themes", "List the text's themes, {most} at most.", "themes array<string>"),
        Prompt("persona", "From a summary of documents make up a person who would ask about them.", "name string, role_description string, themes array<string>"),
        Prompt("question_answer", "Write a question of the persona on the term in the given style and length, and its answer from the contexts alone.", "query string, answer string"),
    )
}


@dataclass(frozen=True)
class Extractor:
    """A property of nodes from the model: ``field`` of the prompt's reply. List properties are taken from all chunks of a text
    (duplicates kept), others from the first chunk."""

    name: str
    field: str
    most: int | None = None
    many: bool = False

    def prompt(self) -> Prompt:
        p = PROMPTS[self.name]
        return p if self.most is None else Prompt(p.name, p.instruction.format(most=self.most), p.output, p.examples, p.language)


EXTRACTORS = {
    "summary": Extractor("summary", "text"),
    "keyphrases": Extractor("keyphrases", "keyphrases", 5, True),
    "title": Extractor("title", "text"),
    "headlines": Extractor("headlines", "headlines", 5, True),
    "entities": Extractor("entities", "entities", 10, True),
    "topic_description": Extractor("topic", "text"),
    "themes": Extractor("themes", "themes", 10, True),
}
#: Words of a text that one request holds.
CHUNK_WORDS = 24_000


def document_nodes(docs: DataFrame, key: str = "doc_id", text: str = "text", *metadata: str) -> Graph:
    """Documents as nodes of type ``document``; blank texts are left out."""
    rows = docs.where(F.trim(F.col(text)) != "")
    nodes = rows.select(F.col(key).cast("string").alias("id"), F.lit("document").alias("type"), F.col(text).alias("page_content"), *metadata)
    edges = "id string, type string, src string, dst string, bidirectional boolean"
    return Graph(nodes, docs.sparkSession.createDataFrame([], edges))


def extract(name: str, judge: Judge, where: Column | None = None, extractor: Extractor | None = None) -> Step:
    """Set the property ``name`` of the nodes that fit and lack it. A text of more than CHUNK_WORDS words is asked about part by part; lists of the parts are
    joined, and where one text is wanted the parts' replies are asked about once more, together."""
    e = extractor or EXTRACTORS[name]

    def step(g: Graph) -> Graph:
        lacking = g.nodes if where is None else g.nodes.where(where)
        lacking = lacking.where(F.col(name).isNull()) if name in g.nodes.columns else lacking
        cut = splitters.window_chunks(lacking, CHUNK_WORDS, "id", "page_content")
        out = judge.ask(cut, e.prompt(), text=F.col("chunk")).select("id", "pos", F.col(f"out.{e.field}").alias("v")).where("v is not null")
        parts = out.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("_vs"))
        if e.many:
            out = parts.select("id", F.flatten("_vs").alias("_v"))
        else:
            several = judge.ask(parts.where("size(_vs) > 1"), e.prompt(), text=F.array_join("_vs", "\n\n"))
            out = parts.where("size(_vs) = 1").select("id", F.col("_vs")[0].alias("_v")).unionByName(several.select("id", F.col(f"out.{e.field}").alias("_v")))
        joined = g.nodes.join(out, "id", "left")
        value = F.coalesce(F.col(name), F.col("_v")) if name in g.nodes.columns else F.col("_v")
        return Graph(joined.withColumn(name, value).drop("_v"), g.edges)

    return step


def embed(name: str, source: str, judge: Judge, where: Column | None = None) -> Step:
    """The vector of a text property."""

    def step(g: Graph) -> Graph:
        fits = F.col(source).isNotNull() & (F.lit(True) if where is None else where)
        nodes = embedded(g.nodes.withColumn("_t", F.when(fits, F.col(source))), "_t", judge.embedder, name)
        return Graph(nodes.withColumn(name, F.when(F.col("_t").isNotNull(), F.col(name))).drop("_t"), g.edges)

    return step


def split(least: int = 300, most: int = 1000) -> Step:
    """Documents with headlines become chunks too, below them and one after the other."""

    def step(g: Graph) -> Graph:
        chunks = splitters.headline_chunks(g.nodes.where("type = 'document'"), least, most, "id", "page_content")
        made = splitters.chunk_graph(chunks)
        return g.add(made.nodes, made.edges)

    return step


def relate_by_cosine(kind: str, vector: str, threshold: float, node_type: str | None = None) -> Step:
    """Edges both ways between nodes (of one type, if given) with near vectors; all of these need a vector."""

    def step(g: Graph) -> Graph:
        nodes = g.nodes.where(F.col("type") == node_type) if node_type else g.nodes
        found = pairs.cosine_pairs(nodes.where(F.col(vector).isNotNull()), threshold, "id", vector)
        return g.add(g.nodes.limit(0), graphs.similarity_edges(found, kind))

    return step


def relate_by_overlap(kind: str = "entities_overlap", items: str = "entities", threshold: float = 0.01, item_threshold: float = 0.9) -> Step:
    def step(g: Graph) -> Graph:
        found = pairs.overlap_pairs(g.nodes.where(F.col(items).isNotNull()), threshold, item_threshold, key="id", items=items)
        edges = graphs.similarity_edges(found, kind, "score", bidirectional=False)
        shown = found.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("overlapped").alias("overlapped_items"))
        return g.add(g.nodes.limit(0), edges.join(shown, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d"))).drop("_s", "_d"))

    return step


def relate_by_jaccard(kind: str, items: str, threshold: float = 0.5) -> Step:
    def step(g: Graph) -> Graph:
        return g.add(g.nodes.limit(0), graphs.similarity_edges(pairs.jaccard_pairs(g.nodes, threshold, "id", items), kind))

    return step


def drop_nodes(predicate: Column) -> Step:
    return lambda g: g.where(~F.coalesce(predicate, F.lit(False)))


def transformed(g: Graph, steps: Iterable[Step | list[Step]]) -> Graph:
    """Apply the steps in order; a list is a group of independent steps, which Spark schedules as it does all. Each result is written, so
    that no model is asked twice."""
    for step in steps:
        for one in step if isinstance(step, list) else [step]:
            g = one(g)
            g = Graph(written(g.nodes, "nodes"), written(g.edges, "edges"))
    return g


def default_steps(docs: DataFrame, judge: Judge, text: str = "text", n_tokens: Column | None = None) -> list[Step | list[Step]]:
    """By the texts' lengths: with many long ones headlines and chunks, else documents as they are; too short texts are an error."""
    kind = splitters.choose_pipeline(docs, F.size(words(F.col(text))) if n_tokens is None else n_tokens)
    document, chunk = F.col("type") == "document", F.col("type") == "chunk"
    if kind == "headline":
        return [
            extract("headlines", judge, document),
            split(),
            extract("summary", judge, document),
            [embed("summary_embedding", "summary", judge), extract("themes", judge, chunk), extract("entities", judge, chunk)],
            [relate_by_cosine("summary_similarity", "summary_embedding", 0.7, "document"), relate_by_overlap()],
        ]
    return [
        extract("summary", judge, document),
        [embed("summary_embedding", "summary", judge), extract("themes", judge, document), extract("entities", judge, document)],
        [relate_by_cosine("summary_similarity", "summary_embedding", 0.5, "document"), relate_by_overlap()],
    ]


def personas(g: Graph, judge: Judge, n: int = 3) -> DataFrame:
    """(persona, role_description, persona_themes): of up to ``n`` groups of documents, the first by their leaders, from the longest summary."""
    docs = g.nodes.where("type = 'document' and summary is not null and summary_embedding is not null")
    if not docs.limit(1).count():
        raise ValueError("no document has a summary with a vector")
    speakers = testset.persona_groups(docs).select("group", F.col("representative").alias("id")).distinct().orderBy("group").limit(n)
    out = judge.ask(speakers.join(docs.select("id", "summary"), "id"), PROMPTS["persona"], summary=F.col("summary"))
    named = out.where("out is not null").select(F.col("out.name").alias("persona"), F.col("out.role_description").alias("role_description"), F.col("out.themes").alias("persona_themes"))
    return written(named.dropDuplicates(["persona"]), "personas")


def _sampled(terms: DataFrame, contexts: DataFrame, who: DataFrame, judge: Judge, n: int, name: str, seed: int) -> DataFrame:
    """Scenarios of (node_id, term) and their samples; ``contexts``: node_id and its array of texts."""
    everyone = F.array(*[F.lit(r["persona"]) for r in who.select("persona").collect()])  # a few persons
    picked = testset.scenarios(terms.withColumn("persona", F.explode(everyone)), n, seed)
    rows = written(picked.join(contexts, "node_id"), "scenarios")
    inputs = {c: F.col(c) for c in ("persona", "term", "style", "length", "contexts")}
    out = judge.ask(rows, PROMPTS["question_answer"], **inputs).where("out is not null")
    kept = out.select(F.col("out.query").alias("user_input"), F.col("out.answer").alias("reference"), F.col("contexts").alias("reference_contexts"), "persona", "style", "length")
    return kept.withColumn("synthesizer_name", F.lit(name))


def single_hop(g: Graph, who: DataFrame, judge: Judge, n: int, seed: int = 42) -> DataFrame:
    """Questions on one node and one of its entities: chunks, or documents if as many of them or more have entities."""
    held = g.nodes.where(F.size("entities") > 0)
    counts = {r["type"]: r["count"] for r in held.groupBy("type").count().collect()}  # one row per type
    kind = "chunk" if counts.get("chunk", 0) > counts.get("document", 0) else "document"
    nodes = held.where(F.col("type") == kind)
    terms = nodes.select(F.col("id").alias("node_id"), F.explode(F.array_distinct("entities")).alias("term"))
    return _sampled(terms, nodes.select(F.col("id").alias("node_id"), F.array("page_content").alias("contexts")), who, judge, n, "single_hop_specific", seed)


def multi_hop_specific(g: Graph, who: DataFrame, judge: Judge, n: int, seed: int = 42) -> DataFrame:
    """Questions on two nodes that share an entity."""
    if "overlapped_items" not in g.edges.columns:
        raise ValueError("the graph has no edges of overlapping entities")
    linked = g.edges.where("type = 'entities_overlap' and src <> dst").select(F.concat_ws("|", "src", "dst").alias("node_id"), "src", "dst", "overlapped_items")
    terms = linked.select("node_id", F.explode("overlapped_items").alias("o")).select("node_id", F.col("o.a").alias("term"))
    return _sampled(terms, _hops(linked, g), who, judge, n, "multi_hop_specific", seed)


def multi_hop_abstract(g: Graph, who: DataFrame, judge: Judge, n: int, seed: int = 42) -> DataFrame:
    """Questions on two themes of different documents of a cluster, which similar summaries link; documents with chunks speak through these."""
    kept = g.nodes.select("id", "themes", "page_content")
    clusters = graphs.n_indirect_clusters(g, n, 3, F.col("type") == "summary_similarity", seed)
    clusters = written(clusters.select(F.concat_ws("|", "cluster").alias("cluster_id"), F.explode("cluster").alias("node_id")), "clusters")
    below = g.edges.where("type = 'child'").select(F.col("src").alias("root"), F.col("dst").alias("id"))
    own = kept.join(below, "id", "left").select(F.coalesce("root", "id").alias("node_id"), F.explode("themes").alias("theme")).distinct()
    held = clusters.join(own, "node_id")
    left, right = (held.withColumnsRenamed({"node_id": m, "theme": t}) for m, t in (("m", "x"), ("k", "y")))
    both = left.join(right, "cluster_id").where("m < k and x <> y")  # a cluster has three documents at most
    terms = both.select(F.col("cluster_id").alias("node_id"), F.concat_ws(" and ", F.least("x", "y"), F.greatest("x", "y")).alias("term")).distinct()
    contexts = testset.cluster_contexts(clusters, below, kept).withColumnRenamed("cluster_id", "node_id")
    return _sampled(terms, contexts, who, judge, n, "multi_hop_abstract", seed)


def _hops(linked: DataFrame, g: Graph) -> DataFrame:
    texts = g.nodes.select("id", "page_content")
    both = linked.join(texts.withColumnsRenamed({"id": "src", "page_content": "t1"}), "src").join(texts.withColumnsRenamed({"id": "dst", "page_content": "t2"}), "dst")
    return both.select("node_id", testset.tagged_contexts(F.array("t1", "t2")).alias("contexts")).dropDuplicates(["node_id"])


SYNTHESIZERS: dict[str, Callable[..., DataFrame]] = {"single_hop_specific": single_hop, "multi_hop_abstract": multi_hop_abstract, "multi_hop_specific": multi_hop_specific}


def generate(g: Graph, judge: Judge, n: int, n_personas: int = 3, seed: int = 42, weights: dict[str, float] | None = None) -> DataFrame:
    """About ``n`` samples (shares are rounded up): user_input, reference, reference_contexts, persona, style, length, synthesizer_name.
    Without ``weights``, all synthesizers that find something to work on share them equally."""
    who = personas(g, judge, n_personas)
    if weights is None:
        kinds = {r["type"]: r["count"] for r in g.edges.groupBy("type").count().collect()}  # one row per type
        found = {"single_hop_specific": g.nodes.where(F.size("entities") > 0).limit(1).count(), "multi_hop_abstract": kinds.get("summary_similarity", 0), "multi_hop_specific": kinds.get("entities_overlap", 0)}
        weights = testset.query_distribution(found)
    parts = [SYNTHESIZERS[name](g, who, judge, k, seed) for name, k in testset.proportional_counts(weights, n).items() if k]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return written(out, "testset")


def to_evaluation(samples: DataFrame) -> DataFrame:
    """The columns that ``evaluate`` knows."""
    return samples.drop("synthesizer_name", "persona", "style", "length")
