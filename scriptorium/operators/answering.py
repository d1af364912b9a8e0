"""Questions and answers: routing, follow-up enrichment, prompts, source lists, tools, and the default generator."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.functions import vector as V

#: Keywords of the router by tool, in the order they are tried; a keyword counts anywhere in a question.
KEYWORDS = {
    "summarizer": ("summarize", "summary", "overview", "zusammenfassung", "résumé"),
    "comparator": ("compare", "difference", "versus", "vs", "vergleich", "comparer"),
    "extractor": ("extract", "list all", "find all", "enumerate", "aufzählen"),
}
#: What is put before a question that goes to a tool.
PREFIXES = {
    "summarizer": "Please provide a concise summary based on the context. Original request: ",
    "comparator": "Please compare and contrast the relevant information across documents. Original request: ",
    "extractor": "Please extract and list the relevant structured information. Original request: ",
}
#: The tools' own instructions and how many chunks they ask for.
TOOLS = {
    "retriever": (5, None),
    "summarizer": (8, "Please provide a clear, structured summary of the following document content. Organize by main topics. Be concise. Cite page numbers where relevant."),
    "comparator": (8, "Please compare and contrast the relevant information from the documents. Structure your response as: \n1. Key similarities\n2. Key differences\n3. Summary\nClearly label which document each point comes from. Cite page numbers."),
    "extractor": (8, "Please extract and list the requested information in a structured format. Use numbered lists or tables where appropriate. Include the source document and page number for each extracted item. Do not add information that is not present in the context."),
}
#: What stands for a context that is not there, and the lines above context, history and question.
NO_CONTEXT = "No relevant context found in the loaded documents."
CONTEXT_HEAD, HISTORY_HEAD, QUESTION_HEAD = "DOCUMENT CONTEXT:\n\n", "CONVERSATION HISTORY:\n", "\n\nUSER QUESTION: "
SHORT_QUESTION, ENRICH_FROM, HISTORY = 5, 4, 6


class Generator(Protocol):
    """Turns prompts into answers: a function of a frame with `prompt` that adds `answer`, null where it fails. A model behind a pandas
    UDF fits."""

    def __call__(self, prompts: DataFrame) -> DataFrame: ...


def route(question: Column) -> Column:
    low = F.lower(question)
    out = F.when(F.lit(False), F.lit(""))
    for tool, words in KEYWORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = out.when(hit, tool)
    return out.otherwise("retriever")


def rewritten(question: Column, tool: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, prefix in PREFIXES.items():
        out = out.when(tool == name, F.concat(F.lit(prefix), question))
    return out.otherwise(question)


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation, with their place `back` counted from the end."""
    back = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return messages.withColumn("back", back).where(F.col("back") <= n)


def _joined(lines: Column, separator: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("turn").alias("turn"), lines.alias("line")))), lambda x: x["line"]), separator)


def enriched(questions: DataFrame, messages: DataFrame) -> DataFrame:
    """(conv_id, question) + enriched: a question of five words or fewer gets the user's turns among the last four messages before it."""
    recent = last_messages(messages, ENRICH_FROM).where("role = 'user'").groupBy("conv_id").agg(_joined(F.col("text"), " ").alias("recent"))
    own = T.strip(F.col("question"))
    words = F.when(own == "", 0).otherwise(F.size(F.split(own, r"(?U)\s+")))
    joined = questions.join(recent, "conv_id", "left")
    return joined.withColumn("enriched", F.when((words <= SHORT_QUESTION) & F.col("recent").isNotNull(), F.concat("recent", F.lit(" "), "question")).otherwise(F.col("question"))).drop("recent")


def history(messages: DataFrame) -> DataFrame:
    """conv_id, history: the last six messages as lines; whoever is not the user is the assistant."""
    who = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    lines = last_messages(messages, HISTORY).groupBy("conv_id").agg(_joined(F.concat(who, F.col("text")), "\n").alias("lines"))
    return lines.select("conv_id", F.concat(F.lit(HISTORY_HEAD), "lines").alias("history"))


def contexts(hits: DataFrame) -> DataFrame:
    """query_id, context: hits in rank order, each with its source line."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Source: "), "source", F.lit(" | Page: "), "page", F.lit(" | Section: "), "section", F.lit(" | Confidence: "), "confidence", F.lit("\n"), "text", F.lit("\n"))
    rows = hits.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n").alias("body"))
    return rows.select("query_id", F.concat(F.lit(CONTEXT_HEAD), "body").alias("context"))


def user_message(question: Column, context: Column, history_block: Column) -> Column:
    """History, context and question; a null history leaves no line behind, a null context says so."""
    before = F.when(history_block.isNotNull() & (history_block != ""), F.concat(history_block, F.lit("\n\n"))).otherwise("")
    return F.concat(before, F.coalesce(context, F.lit(NO_CONTEXT)), F.lit(QUESTION_HEAD), question)


def sources(hits: DataFrame) -> DataFrame:
    """query_id, position, document, page, section, confidence, score: the first hit of each source and page, in rank order."""
    first = F.row_number().over(W.partitionBy("query_id", "source", "page").orderBy("rank"))
    once = hits.withColumn("nth", first).where("nth = 1")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return once.select("query_id", place.alias("position"), F.col("source").alias("document"), "page", "section", "confidence", "score")


def answer_confidence(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, confidence: that of the best hit, Low without any."""
    top = hits.where("rank = 1").select("query_id", "confidence")
    return queries.select("query_id").join(top, "query_id", "left").select("query_id", F.coalesce("confidence", F.lit("Low")).alias("confidence"))


def tool_requests(questions: DataFrame) -> DataFrame:
    """(query_id, question) -> query_id, tool, n_results, request: what each tool's own run would send."""
    tool = route(F.col("question"))
    n, text = F.when(F.lit(False), F.lit(0)), F.when(F.lit(False), F.lit(""))
    for name, (count, instruction) in TOOLS.items():
        n = n.when(F.col("tool") == name, count)
        text = text.when(F.col("tool") == name, F.col("question") if instruction is None else F.concat(F.lit(instruction + "\n\nOriginal request: "), "question"))
    return questions.select("query_id", "question", tool.alias("tool")).select("query_id", "tool", n.alias("n_results"), text.alias("request"))


def extractive_answers(hits: DataFrame, limit: int = 2) -> DataFrame:
    """The default generator: the first sentences of the best hit. query_id, answer."""
    best = hits.where("rank = 1").select("query_id", F.slice(T.sentences(F.col("text")), 1, limit).alias("s"))
    return best.select("query_id", F.array_join("s", " ").alias("answer"))


#: How much likeness counts against novelty.
NOVELTY = 0.7
DAMPING, ROUNDS = 0.85, 40
#: Likenesses of sentences that a task holds at once (32 MB).
CELLS = 1 << 22
CITED = "query_id long, answer string, cites array<struct<chunk_id:string,sentence:int,text:string>>"


def _walked(step: Callable[[np.ndarray], np.ndarray], total: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The rank after ROUNDS. step: a row of weights times the likenesses (that of a sentence with itself is 0), whose rows add up to `total`."""
    n = len(total)
    start = np.maximum(wanted, 0.0)
    start = start / start.sum() if start.sum() > 0 else np.full(n, 1 / n)
    rank = start.copy()
    for _ in range(ROUNDS):
        shared = np.divide(rank, total, out=np.zeros(n), where=total > 0)
        rank = (1 - DAMPING) * start + DAMPING * (step(shared) + rank[total <= 0].sum() / n)
    return rank


def sentence_ranks(sims: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """PageRank over sentences: a walk goes on to those alike, and starts anew (by DAMPING) at those like the question."""
    ways = np.where(np.eye(len(sims), dtype=bool), 0.0, np.maximum(sims, 0.0))
    return _walked(lambda w: w @ ways, ways.sum(1), wanted)


def vector_ranks(x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """sentence_ranks of sentences by their vectors of length 1 (or 0), with CELLS likenesses at once, however many sentences there are.

    Vectors without negative entries, as those of counted words, have no negative likenesses, so a step is two products with the vectors themselves.
    """
    n = len(x)
    if n * n <= CELLS:
        return sentence_ranks(x @ x.T, wanted)
    if (x >= 0).all():
        own = (x * x).sum(1)
        return _walked(lambda w: np.maximum(x @ (w @ x) - w * own, 0.0), (x * (x.sum(0) - x)).sum(1), wanted)
    size = max(1, CELLS // n)

    def ways(a: int) -> np.ndarray:
        block = np.maximum(x[a : a + size] @ x.T, 0.0)
        block[np.arange(len(block)), np.arange(a, a + len(block))] = 0.0
        return block

    total = np.concatenate([ways(a).sum(1) for a in range(0, n, size)])
    return _walked(lambda w: sum(w[a : a + size] @ ways(a) for a in range(0, n, size)), total, wanted)


def most_novel(rank: np.ndarray, sims: np.ndarray, count: int, novelty: float = NOVELTY) -> list[int]:
    """Maximal marginal relevance: the best ranked first, then each time the one that is best by rank and least like those chosen; ties to the first."""
    return _most_novel(rank, lambda i: sims[:, i], count, novelty)


def _most_novel(rank: np.ndarray, alike: Callable[[int], np.ndarray], count: int, novelty: float = NOVELTY) -> list[int]:
    """alike: the likenesses of all sentences with one of them."""
    scaled = np.round(rank / rank.max(), 9) if len(rank) and rank.max() > 0 else rank
    chosen: list[int] = []
    like = np.zeros(len(rank))
    while len(chosen) < min(count, len(rank)):
        score = novelty * scaled - (1 - novelty) * like
        score[chosen] = -np.inf
        chosen.append(int(score.argmax()))
        own = np.round(alike(chosen[-1]), 9)
        like = np.maximum(like, own) if len(chosen) > 1 else own
    return chosen


def _ranked_answer(limit: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "at"], kind="stable").drop_duplicates("sentence")
        x = np.array(rows["vec"].tolist(), np.float64)
        length = np.sqrt((x * x).sum(1))
        x = np.divide(x, length[:, None], out=np.zeros_like(x), where=length[:, None] > 0)
        chosen = _most_novel(vector_ranks(x, rows["likeness"].to_numpy(np.float64)), lambda i: x @ x[i], limit)
        own = rows.iloc[chosen]
        cites = [{"chunk_id": c, "sentence": int(a), "text": s} for c, a, s in zip(own["chunk_id"], own["at"], own["sentence"], strict=True)]
        return pd.DataFrame({"query_id": [rows["query_id"].iloc[0]], "answer": [" ".join(own["sentence"])], "cites": [cites]})

    return run


def ranked_answers(questions: DataFrame, hits: DataFrame, limit: int = 2, embed=V.hashed_embedding, most: int | None = None) -> DataFrame:
    """An extractive generator over all hits: (query_id, question) and hits (query_id, rank, chunk_id, text) -> query_id, answer, cites.

    The sentences of a question's hits are a graph by likeness; those that PageRank puts first, started at those like the question, make the
    answer, as long as they say something new. cites names the chunk and the place of each sentence in it. All sentences take part, unless a
    caller asks for the `most` that are most like the question; what meets in one task are the sentences of one question's hits, and likenesses are
    held by CELLS. Equal sentences count once. A question without sentences has no row.
    """
    rows = hits.select("query_id", "rank", "chunk_id", F.posexplode(T.sentences(F.col("text"))).alias("at", "sentence"))
    asked = questions.select("query_id", embed(F.col("question")).alias("asked"))
    like = rows.withColumn("vec", embed(F.col("sentence"))).join(asked, "query_id").withColumn("likeness", F.round(V.cosine(F.col("vec"), F.col("asked")), 9)).drop("asked")
    if most is not None:
        best = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("likeness").desc(), "rank", "at"))
        like = like.withColumn("nth", best).where(F.col("nth") <= most)
    some = like.select(F.col("query_id").cast("long").alias("query_id"), "rank", F.col("chunk_id").cast("string").alias("chunk_id"), "at", "sentence", "vec", "likeness")
    return some.groupBy("query_id").applyInPandas(_ranked_answer(limit), CITED)


def generated(questions: DataFrame, hits: DataFrame, generate: Generator) -> DataFrame:
    """(query_id, request) with hits -> query_id, answer: the generator gets context and request as one prompt."""
    prompts = questions.join(contexts(hits), "query_id").select("query_id", user_message(F.col("request"), F.col("context"), F.lit(None).cast("string")).alias("prompt"))
    return generate(prompts).select("query_id", "answer")


def answered(queries: DataFrame, hits: DataFrame, generate: Generator | None = None, ranked: bool = False) -> DataFrame:
    """query_id, tool_used, request, answer, confidence, n_sources, status: one row a question, hits or not.

    Without a generator the answer is the first sentences of the best hit, or with `ranked` the best sentences of all hits. status: ok; no_context, where nothing was found; failed,
    where the generator gave none, and then the answer is null.
    """
    tool = route(F.col("question"))
    base = queries.select("query_id", tool.alias("tool_used"), rewritten(F.col("question"), tool).alias("request"))
    counted = sources(hits).groupBy("query_id").agg(F.count("*").alias("n_sources"))
    extract = ranked_answers(queries, hits).select("query_id", "answer") if ranked else extractive_answers(hits)
    answers = generated(base, hits, generate) if generate else extract
    out = base.join(answers, "query_id", "left").join(answer_confidence(queries, hits), "query_id", "left").join(counted, "query_id", "left")
    status = F.when(F.col("n_sources").isNull(), "no_context").when(F.col("answer").isNull(), "failed").otherwise("ok")
    answer = F.when(F.col("n_sources").isNull(), F.lit(NO_CONTEXT)).otherwise(F.col("answer"))
    return out.select("query_id", "tool_used", "request", answer.alias("answer"), "confidence", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), status.alias("status"))


#: Fixed value: the answer where a selection finds nothing.
NO_SELECTION = "Could not find relevant content for the selected text."


def selection_prompt(selected: Column, question: Column) -> Column:
    """The question as it is put for a selected text."""
    return F.concat(F.lit('The user selected this text from the document:\n"'), selected, F.lit('"\n\nTheir question: '), question)


def selection_answers(queries: DataFrame, hits: DataFrame, generate: Generator | None = None) -> DataFrame:
    """(query_id, selected, question) and the hits of a selection search -> query_id, tool_used, request, answer, confidence, n_sources, status.

    The tool is always the retriever. A selection without hits gets the fixed answer.
    """
    base = queries.select("query_id", selection_prompt(F.col("selected"), F.col("question")).alias("request"))
    counted = sources(hits).groupBy("query_id").agg(F.count("*").alias("n_sources"))
    answers = generated(base, hits, generate) if generate else extractive_answers(hits)
    out = base.join(answers, "query_id", "left").join(answer_confidence(queries, hits), "query_id", "left").join(counted, "query_id", "left")
    none = F.col("n_sources").isNull()
    status = F.when(none, "no_context").when(F.col("answer").isNull(), "failed").otherwise("ok")
    return out.select("query_id", F.lit("retriever").alias("tool_used"), "request", F.when(none, F.lit(NO_SELECTION)).otherwise(F.col("answer")).alias("answer"), "confidence", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), status.alias("status"))


def remembered(messages: DataFrame, new: DataFrame) -> DataFrame:
    """Adds (conv_id, question, request, answer) as two turns at the end of each conversation; both forms of the question are kept."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("last"))
    rows = new.join(last, "conv_id", "left").withColumn("last", F.coalesce("last", F.lit(-1)))
    turns = F.explode(F.array(F.struct((F.col("last") + 1).alias("turn"), F.lit("user").alias("role"), F.col("request").alias("text")), F.struct((F.col("last") + 2).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text"))))
    added = rows.select("conv_id", turns.alias("m")).select("conv_id", F.col("m.turn").cast("long").alias("turn"), "m.role", "m.text")
    return messages.select("conv_id", "turn", "role", "text").unionByName(added)


def forgotten(messages: DataFrame, conv_id: int) -> DataFrame:
    return messages.where(F.col("conv_id") != conv_id)
