"""Evidence for grounded answers: a budget of words, prompts, the deterministic client, and the check of model replies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.functions import text as T

CONTRACT = (
    "Answer only from the evidence below. Every sentence of the answer needs the point_id of evidence that says exactly this; "
    "leave out what the evidence does not say, and set abstained to true if nothing useful is left.\n"
    "Reply with one JSON object: abstained, answer, citations (point_ids), supported_claims (claim, point_ids), unsupported_claims (claim, reason), abstention_reason."
)


def body() -> Column:
    """What a chunk says as evidence, of ``text, context_text``: its context, else its text."""
    return F.coalesce(T.optional(F.col("context_text")), T.strip(F.col("text")))


def fitting(sized: DataFrame, budget: int, rank: str = "rank") -> DataFrame:
    """The hits that fit a budget of words, in rank order, with ``room``, the words left for each, and ``evidence_no`` from 1.

    sized: ``query_id``, a rank and ``words``, the number of words of the body; bodies themselves are not needed. Blank ones are skipped at no cost.
    """
    w = W.partitionBy("query_id").orderBy(rank)
    left = F.lit(budget) - F.coalesce(F.sum("words").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = sized.where("words > 0").withColumn("room", left).where("room > 0")
    return kept.withColumn("evidence_no", F.row_number().over(w)).drop("words")


def shortened(body: Column, room: Column) -> Column:
    """The body, or of one with more words than there is room for the first of them."""
    return F.when(F.size(T.words(body)) > room, T.first_words(body, room.cast("int"))).otherwise(body)


def evidence(hits: DataFrame, budget: int, rank: str = "rank") -> DataFrame:
    """The hits that fit a budget of words, in rank order, with ``body`` (the last one cut) and ``evidence_no`` from 1.

    hits: ``query_id, point_id, text, context_text`` and a rank. Blank bodies are skipped at no cost.
    """
    sized = hits.withColumn("_body", body()).withColumn("words", F.size(T.words(F.col("_body"))))
    return fitting(sized, budget, rank).withColumn("body", shortened(F.col("_body"), F.col("room"))).drop("_body", "room")


def prompts(queries: DataFrame, found: DataFrame) -> DataFrame:
    """``query_id, prompt, evidence_ids``: of each query its question and numbered blocks; at most one budget of words each."""
    names = F.array_join(F.coalesce("passage_types", F.array().cast("array<string>")), ", ")
    block = F.concat(
        F.lit("Evidence [E"), F.col("evidence_no").cast("string"), F.lit("] point_id="), F.col("point_id"), F.lit("\nTitle: "), F.coalesce("title", F.lit("")), F.lit("\nChunk kind: "), F.coalesce("chunk_kind", F.lit("")),
        F.lit("\nPassage types: "), names, F.lit("\nContent: "), F.col("body"),
    )
    listed = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("evidence_no", block.alias("b"), "point_id"))).alias("e"))
    text = F.concat(F.lit(CONTRACT + "\n\nQuestion: "), F.col("text"), F.lit("\n\n"), F.coalesce(F.array_join(F.transform("e", lambda x: x["b"]), "\n\n"), F.lit("No evidence provided.")))
    return queries.join(listed, "query_id", "left").select("query_id", text.alias("prompt"), F.coalesce(F.transform("e", lambda x: x["point_id"]), F.array().cast("array<string>")).alias("evidence_ids"))


def heuristic(found: DataFrame) -> DataFrame:
    """``query_id, answer, point_id, abstained`` of the deterministic client: the first sentence of the first evidence."""
    sentence = T.first_sentence(F.col("body"))
    return found.where("evidence_no = 1").select("query_id", sentence.alias("answer"), "point_id", (sentence == "").alias("abstained"))


def complete(prompted: DataFrame, client: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """``query_id, raw``: replies of a pluggable client; ``client()`` is called once per task and gives a function of prompts."""
    kind = prompted.schema["query_id"].dataType.simpleString()

    def run(batches):
        import pandas as pd

        ask = client()
        for pdf in batches:
            yield pd.DataFrame({"query_id": pdf["query_id"], "raw": ask(list(pdf["prompt"]))})

    return prompted.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, raw string")


REPLY = "abstained boolean, answer string, citations array<string>, supported_claims array<struct<claim:string,point_ids:array<string>>>, unsupported_claims array<struct<claim:string,reason:string>>, abstention_reason string"


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def payload(raw: Column) -> Column:
    """The object of a reply as text: the whole reply, else from its first to its last brace; null if that is none."""
    whole, inner = F.try_parse_json(raw), F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    fallback = F.when(whole.isNull() & _is(F.try_parse_json(inner), "OBJECT"), inner)
    return F.when(_is(whole, "OBJECT"), raw).otherwise(fallback)


def cited_ids(citations: Column) -> Column:
    """Ids of citations, which are texts or objects with a point_id; each once, in order."""
    one = lambda c: F.when(c.startswith("{"), F.get_json_object(c, "$.point_id")).otherwise(c)
    return F.array_distinct(F.filter(F.transform(F.coalesce(citations, F.array().cast("array<string>")), one), lambda c: c.isNotNull() & (c != "")))


def valid_citations(cited: Column, known: Column) -> Column:
    return F.filter(cited, lambda c: F.array_contains(known, c))


def checked_answers(replies: DataFrame, min_citations: int = 1) -> DataFrame:
    """Answers from replies (``query_id, raw, evidence_ids``): citations and claims only of evidence, else abstained."""
    r = replies.withColumn("_p", payload(F.col("raw"))).withColumn("_j", F.from_json("_p", REPLY)).withColumn("_v", F.try_parse_json(F.col("_p")))
    valid = valid_citations(cited_ids(F.col("_j.citations")), F.col("evidence_ids"))
    texts = _is(F.try_variant_get(F.col("_v"), "$.answer", "variant"), "STRING")
    answer = F.when(texts, T.optional(F.col("_j.answer")))
    claims = F.filter(
        F.transform(F.coalesce("_j.supported_claims", F.array().cast("array<struct<claim:string,point_ids:array<string>>>")), lambda c: F.struct(T.strip(c["claim"]).alias("claim"), F.array_distinct(F.filter(F.coalesce(c["point_ids"], F.array().cast("array<string>")), lambda x: F.array_contains(valid, x))).alias("point_ids"))),
        lambda c: c["claim"].isNotNull() & (F.size(c["point_ids"]) > 0),
    )
    unsupported = F.filter(
        F.transform(F.coalesce("_j.unsupported_claims", F.array().cast("array<struct<claim:string,reason:string>>")), lambda c: F.struct(T.optional(c["claim"]).alias("claim"), T.optional(c["reason"]).alias("reason"))),
        lambda c: c["claim"].isNotNull() & c["reason"].isNotNull(),
    )
    said = F.coalesce(F.col("_j.abstained"), F.lit(False))
    ok = F.col("_p").isNotNull() & ~said & answer.isNotNull() & (F.size(valid) >= min_citations) & (F.size("evidence_ids") > 0)
    none = F.array().cast("array<string>")
    return r.withColumn("_ok", F.coalesce(ok, F.lit(False))).select(
        "query_id", F.when(F.col("_ok"), answer).otherwise("").alias("answer"), (~F.col("_ok")).alias("abstained"), F.when(F.col("_ok"), valid).otherwise(none).alias("citations"),
        F.when(F.col("_ok"), claims).otherwise(F.array().cast("array<struct<claim:string,point_ids:array<string>>>")).alias("supported_claims"),
        F.when(F.col("_ok") | said, unsupported).otherwise(F.array().cast("array<struct<claim:string,reason:string>>")).alias("unsupported_claims"),
        F.when(said, T.optional(F.col("_j.abstention_reason"))).alias("abstention_reason"),
    )


def display_rank(dense: Column, sparse: Column, fusion: Column, rerank: Column) -> Column:
    """``dense 1 | sparse 2``: the ranks a hit has."""
    part = lambda name, v: F.when(v.isNotNull(), F.concat(F.lit(name + " "), v.cast("string")))
    return F.concat_ws(" | ", part("dense", dense), part("sparse", sparse), part("fusion", fusion), part("rerank", rerank))
