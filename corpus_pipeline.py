"""From raw documents to packed sequences: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but
the last return the columns of documents.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from billweave.llm.decontaminate import decontaminated
from billweave.llm.near_dedup import one_of_each
from billweave.llm.packing import TOKENIZER, pack_documents
from billweave.llm.suffix_array import without_repeats
from billweave.llm.toxicity import without_toxic
from billweave.session import configure, shared_folder


#: What is cut are passages of more than 50 words that stand elsewhere, too. 51 words take 315 bytes in the median, but 99 of a hundred
#: such runs take 254 or more. Of the documents that share one after near-dedup (631 at sf0.1), 250 bytes cut 629, 300 bytes 623, 400 bytes
#: 462; of the others 512, 402 and 339 of 7,603 lose text, as they repeat shorter passages or lines of their own.
CUT_BYTES = 250


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.7 or more go."""
    configure(spark)
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with a shingle similarity of 0.75 or more, directly or over others, the first stays."""
    configure(spark)
    return one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of ``CUT_BYTES`` bytes that start more than once are taken out of the texts."""
    configure(spark)
    return without_repeats(docs, length=CUT_BYTES)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more inside benchmark passages go."""
    configure(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left in sequences of at most 4096 tokens."""
    import public_tokenizers

    configure(spark)
    return pack_documents(docs, public_tokenizers.path(TOKENIZER), max_tokens=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_array", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No SQL says token ids, learned scores or cuts in the middle of texts; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between two stages lies in the cluster's shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs.write.parquet(path := f"{folder}/{number}-{name}")
            docs = spark.read.parquet(path)
    return docs
