"""Test-set synthesis: personas, scenarios and their samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import forget, written
from .pairs import cosine_pairs
from .sampling import shuffled

# The styles and lengths that queries take.
STYLES = ("MISSPELLED", "PERFECT_GRAMMAR", "POOR_GRAMMAR", "WEB_SEARCH_LIKE")
LENGTHS = ("LONG", "MEDIUM", "SHORT")


def persona_groups(nodes: DataFrame, threshold: float = 0.75, key: str = "id", vector: str = "summary_embedding", summary: str = "summary") -> DataFrame:
    """(group, id, representative). Greedy, in the order of ids: a document that no earlier leader is similar to (above ``threshold``)
    leads a group of its own and of all later documents similar to it; so one may be in several groups. The longest summary speaks for
    a group. Documents without a vector or a summary are left out; vectors count as of length 1.

    Each round decides, for all documents at once, those whose earlier similar ones are all decided."""
    rows = written(nodes.where(F.col(vector).isNotNull() & F.col(summary).isNotNull()).select(F.col(key).alias("id"), F.col(summary).alias("summary"), F.col(vector).alias("v")), "documents")
    pairs = written(cosine_pairs(rows, threshold, "id", "v").where(F.col("similarity") > threshold).select("src", "dst"), "pairs")
    state = rows.select("id", F.lit(None).cast("boolean").alias("leads"))
    while True:
        above = pairs.join(state.withColumnsRenamed({"id": "src", "leads": "up"}), "src").groupBy(F.col("dst").alias("id"))
        above = above.agg(F.max(F.coalesce("up", F.lit(False))).alias("led"), F.max(F.col("up").isNull()).alias("open"))
        known = F.coalesce("leads", F.when(F.coalesce("led", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True)))
        state = written(state.join(above, "id", "left").select("id", known.alias("leads")), "state")
        if not state.where("leads is null").limit(1).count():
            break
    leaders = state.where("leads").select("id")
    joined = pairs.join(leaders, F.col("src") == F.col("id"), "left_semi").select(F.col("src").alias("group"), F.col("dst").alias("id")).union(leaders.select(F.col("id").alias("group"), "id"))
    joined = joined.join(rows.select("id", "summary"), "id")
    speaker = joined.groupBy("group").agg(F.max_by("id", F.struct(F.length("summary"), "id")).alias("representative"))
    return joined.select("group", "id").join(speaker, "group")


def proportional_counts(weights: dict[str, float], n: int) -> dict[str, int]:
    """ceil(n * weight) of each name; together they may pass ``n``."""
    import math

    return {k: math.ceil(n * w) for k, w in weights.items()}


def query_distribution(cluster_counts: dict[str, int]) -> dict[str, float]:
    """Equal weights for the synthesizers that found clusters; none is an error."""
    some = [k for k, n in cluster_counts.items() if n > 0]
    if not some:
        raise ValueError("no synthesizer found anything to work on")
    return dict.fromkeys(some, 1 / len(some))


def matching_personas(nodes: DataFrame, personas: DataFrame, themes: str = "themes") -> DataFrame:
    """Nodes with each persona whose themes share one with theirs, without case."""
    p = personas.select("persona", F.explode("persona_themes").alias("_t")).select("persona", F.lower("_t").alias("_t"))
    n = nodes.withColumn("_t2", F.explode(themes)).withColumn("_t2", F.lower("_t2"))
    return n.join(p, F.col("_t2") == F.col("_t")).select(*nodes.columns, "persona").dropDuplicates(["id", "persona"])


#: Rows by hash among which the first ``n`` scenarios are sought; MOST at most, beyond that all rows are ranked.
TRIED, MOST = 8, 100_000


def _first_turns(rows: DataFrame, seed: int) -> DataFrame:
    """Rows (node_id, term, persona, _k) with ``_o``: the hash, after a digit that puts the first row of each node and term ahead."""
    rows = rows.distinct()
    turn = F.row_number().over(Window.partitionBy("node_id", "term").orderBy(shuffled("_k", seed), "_k"))
    return rows.withColumn("_o", F.concat(F.when(turn == 1, F.lit("0")).otherwise(F.lit("8")), shuffled("_k", seed)))


def scenarios(terms: DataFrame, n: int, seed: int = 42, key: str = "node_id", term: str = "term", persona: str = "persona") -> DataFrame:
    """Up to ``n`` scenarios of (node, term, persona) with a style and a length: first one of each node and term, then the
    others, in a fixed random order; styles and lengths go round so that they stay balanced.

    What comes first among the least hashes of all comes first among all rows. So each task gives its least hashes, some times ``n`` of them, and
    nothing else is shuffled; more are taken if these hold too few first rows, as where rows repeat."""
    rows = terms.select(F.col(key).alias("node_id"), F.col(term).alias("term"), F.col(persona).alias("persona"))
    rows = rows.withColumn("_k", F.concat_ws("|", F.col("node_id").cast("string"), "term", "persona"))
    tried, chosen = TRIED * n, None
    while chosen is None and tried <= MOST:
        held = written(rows.withColumn("_h", shuffled("_k", seed)).orderBy("_h", "_k").limit(tried), "least")
        ranked = _first_turns(held.drop("_h"), seed)
        # the last key of all that are held may have rows that are not
        if held.count() < tried or ranked.where(F.col("_o").startswith("0")).limit(n + 1).count() > n:
            chosen = ranked
        else:
            forget(held)
            tried *= 16
    chosen = (_first_turns(rows, seed) if chosen is None else chosen).orderBy("_o", "_k").limit(n)
    ranked = chosen.withColumn("_rank", F.row_number().over(Window.orderBy("_o", "_k")) - 1)  # the sample alone
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (F.pmod(i, F.lit(len(names))) + 1).cast("int"))
    return ranked.select("node_id", "term", "persona", pick(STYLES, F.col("_rank")).alias("style"), pick(LENGTHS, F.floor(F.col("_rank") / len(STYLES))).alias("length"))


def diverse_scenarios(combinations: DataFrame, personas: DataFrame, n: int, seed: int = 42, items: str = "combination") -> DataFrame:
    """Up to ``n`` scenarios of ``combinations`` (id, and their concepts), in a fixed random order: each with each persona that shares
    a concept with it, without case, in all styles and lengths."""
    if n < 1:
        raise ValueError("the number of scenarios must be 1 or more")
    each = lambda names: F.explode(F.array(*map(F.lit, names)))
    matched = matching_personas(combinations, personas, items).withColumn("style", each(STYLES)).withColumn("length", each(LENGTHS))
    keyed = matched.withColumn("_k", F.concat_ws("|", F.col("id").cast("string"), "persona", "style", "length"))
    return keyed.orderBy(shuffled("_k", seed), "_k").limit(n).drop("_k")


def tagged_contexts(contexts: Column) -> Column:
    """Each context with its hop, from 1, ahead of it."""
    return F.transform(contexts, lambda c, i: F.concat(F.lit("<"), (i + 1).cast("string"), F.lit("-hop>\n\n"), c))


def cluster_contexts(clusters: DataFrame, children: DataFrame, nodes: DataFrame) -> DataFrame:
    """Contexts of each cluster (cluster_id, node_id): the texts of the nodes' children (root, id), or of nodes without any."""
    c = clusters.join(children.select(F.col("root").alias("node_id"), F.col("id").alias("child")), "node_id", "left")
    c = c.select("cluster_id", F.coalesce("child", "node_id").alias("id")).distinct()
    texts = c.join(nodes.select("id", "page_content"), "id").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("id", "page_content"))).alias("t"))
    return texts.select("cluster_id", tagged_contexts(F.col("t.page_content")).alias("contexts"))
