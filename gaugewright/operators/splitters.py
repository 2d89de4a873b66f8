"""Documents to chunks: fixed windows and headlines, with the edges between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from .graph import Graph
from .tokens import _tokenizer


def window_chunks(docs: DataFrame, size: int, key: str = "id", text: str = "text") -> DataFrame:
    """(key, pos, chunk): windows of ``size`` words; a text without words has none."""
    w = words(F.col(text))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - 1, F.lit(0)), F.lit(size))
    cut = docs.select(key, w.alias("_w")).where(F.size("_w") > 0).select(key, "_w", F.posexplode(starts).alias("pos", "_at"))
    return cut.select(key, "pos", F.array_join(F.slice("_w", F.col("_at") + 1, size), " ").alias("chunk"))


def _evened(chunks: list[str], least: int, most: int) -> list[str]:
    """Parts of ``most`` words are cut off what is longer; what is below ``least`` words is held back and joined to what comes next, unless
    that is long enough alone."""
    out, held = [], ""
    for chunk in chunks:
        w = chunk.split()
        cut = most * max(0, (len(w) - 1) // most)
        if cut:
            out += [" ".join(w[i : i + most]) for i in range(0, cut, most)]
            chunk, w = " ".join(w[cut:]), w[cut:]
        if len(w) >= least:
            out += [held, chunk] if held else [chunk]
            held = ""
        elif held:
            held += f" {chunk}"
            if len(held.split()) >= least:
                out.append(held)
                held = ""
        else:
            held = chunk
    return [*out, held] if held else out


class HeadlineChunks:
    """A text cut where its headlines first occur, one after the other as they are listed, then evened out by words. One of fewer than
    ``least`` words, or without headlines, stays one chunk; a null text is empty."""

    def eval(self, text: str, headlines: list[str], least: int, most: int):  # noqa: ANN201
        text = text or ""
        chunks = [text]
        if len(text.split()) >= least and headlines:
            places = [0, *(at for h in headlines if h and (at := text.find(h)) >= 0), len(text)]
            chunks = _evened([text[a:b] for a, b in zip(places, places[1:], strict=False)], least, most)
        yield from enumerate(chunks)


class WordWindows:
    """Windows of ``size`` words of a text; one without words has none."""

    def eval(self, text: str, size: int):  # noqa: ANN201
        w = (text or "").split()
        for pos, at in enumerate(range(0, len(w), size)):
            yield pos, " ".join(w[at : at + size])


class TokenWindows:
    """Windows of ``size`` tokens of a text, which share ``overlap``, by the tokenizer in the file ``path``. The cuts lie at tokens' places in the
    text, so windows without overlap give the text back; an empty text has none."""

    def eval(self, text: str, path: str, size: int, overlap: int):  # noqa: ANN201
        if not 0 <= overlap < size:
            raise ValueError("the overlap must be less than the size")
        at = [a for a, _ in _tokenizer(path).encode(text, add_special_tokens=False).offsets] if text else []
        for pos, i in enumerate(range(0, max(1, len(at) - overlap), size - overlap) if text else ()):
            yield pos, text[at[i] if i else 0 : at[i + size] if i + size < len(at) else len(text)]


#: Table functions by their names in SQL: ``SELECT … FROM docs, LATERAL headline_chunks(text, headlines, 300, 1000)``.
SPLITTERS = {"headline_chunks": HeadlineChunks, "word_windows": WordWindows, "token_windows": TokenWindows}


def table_function(name: str):  # noqa: ANN201
    """A splitter for lateral joins: its arguments are columns, those of the other side as ``.outer()``; it gives ``pos`` and ``chunk``. Rows go
    to Python in short runs, not as Arrow batches: a worker would hold thousands of texts at once, with their headlines and chunks."""
    return F.udtf(SPLITTERS[name], returnType="pos int, chunk string", useArrow=False)


def register_splitters(spark: SparkSession) -> None:
    """Make the splitters known to the session's SQL."""
    for name in SPLITTERS:
        spark.udtf.register(name, table_function(name))


def headline_chunks(docs: DataFrame, least: int = 300, most: int = 1000, key: str = "id", text: str = "text", headlines: str = "headlines") -> DataFrame:
    """(key, pos, chunk) of ``HeadlineChunks``."""
    cut = table_function("headline_chunks")(F.col("_text").outer(), F.col("_heads").outer(), F.lit(least), F.lit(most))
    return docs.select(key, F.col(text).alias("_text"), F.col(headlines).alias("_heads")).lateralJoin(cut).select(key, "pos", "chunk")


def chunk_graph(chunks: DataFrame, key: str = "id") -> Graph:
    """Chunks as nodes, with ``child`` edges from their document and ``next`` edges along it."""
    node_id = lambda pos: F.concat_ws("#", F.col(key).cast("string"), pos.cast("string"))
    nodes = chunks.select(node_id(F.col("pos")).alias("id"), F.lit("chunk").alias("type"), F.col("chunk").alias("page_content"))
    child = chunks.select(F.lit("child").alias("type"), F.col(key).cast("string").alias("src"), node_id(F.col("pos")).alias("dst"))
    along = chunks.where("pos > 0").select(F.lit("next").alias("type"), node_id(F.col("pos") - 1).alias("src"), node_id(F.col("pos")).alias("dst"))
    edges = child.union(along).select(F.concat_ws("|", "type", "src", "dst").alias("id"), "type", "src", "dst", F.lit(False).alias("bidirectional"))
    return Graph(nodes, edges)


def choose_pipeline(docs: DataFrame, n_tokens: Column) -> str:
    """``headline`` if a quarter of the texts or more are long, else ``document`` if a quarter are middling, else an error."""
    from .aggregate import length_histogram

    h = length_histogram(docs, n_tokens).first()
    if h["long"] >= 0.25:
        return "headline"
    if h["middle"] >= 0.25:
        return "document"
    raise ValueError("the texts are too short: fewer than a quarter have over 100 tokens")
