"""The queries opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from veritome.llm.bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, outputs=())


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritome.llm.quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from veritome.llm.neighbours import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritome.llm.decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritome.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritome.llm.html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from veritome.llm.token_files import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritome.llm.substrings import dedup

    return dedup(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritome.llm.toxicity import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """Conversations as people paste them: one of four styles of speaker marker each, and for every eleventh turn none but an empty line."""
    from pyspark.sql import functions as F

    styles = (("User: ", "Assistant: ", "System: "), ("Human: ", "AI: ", "System: "), ("Q: ", "A: ", "Context: "), ("### User:\n", "### Assistant:\n", "### System:\n"))
    mark = F.lit("")
    for i, (user, assistant, system) in enumerate(styles):
        said = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", assistant).otherwise(system)
        mark = F.when(F.pmod(F.col("conv_id"), F.lit(4)) == i, said).otherwise(mark)
    bare = F.pmod(F.col("conv_id") * 31 + F.col("turn"), F.lit(11)) == 0
    return conversations.select("conv_id", "turn", F.when(bare, F.concat(F.lit("\n"), "text")).otherwise(F.concat(mark, "text")).alias("text"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritome.llm.chat import turns

    return turns(raw_transcripts(_table(spark, sf_dir, "conversations")))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritome.llm.phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritome.llm.mixing import taken

    return taken(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veritome.llm.lexical import ranked

    return ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_quality, op3_neighbours, op4_decontaminate, op5_simhash, op6_html_text, op7_token_files, op8_suffix_dedup, op9_toxicity, op10_chat, op11_phrases, op12_mixing, op13_lexical_search)}


def oracle_sql() -> dict[str, str]:
    from veritome.llm import decontaminate, lexical, phrases

    return {"op4_decontaminate": decontaminate.ORACLE_SQL, "op11_phrases": phrases.ORACLE_SQL, "op13_lexical_search": lexical.ORACLE_SQL}
