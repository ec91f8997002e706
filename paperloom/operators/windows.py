"""Token windows of conversations with loss masks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

# Marks of a turn, the role whose texts are learned, and the label of tokens that aren't.
START, END, LEARNED, IGNORED = "<|im_start|>", "<|im_end|>", "assistant", -100


def turn_tokens(rows: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, turn, tie, ids and target (whether it is learned) of each turn's tokens: its mark and role, text, end mark.

    A turn is cut at the borders of its text before it is encoded, so no token stands on both sides and the mask covers the text's
    tokens exactly. Strings of special tokens in texts are ordinary text. Null roles and texts are empty.
    """
    given = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def encode(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        known = Tokenizer.from_file(tokenizer)
        known.encode_special_tokens = True
        ids_of = lambda texts: [e.ids for e in known.encode_batch(texts, add_special_tokens=False)]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
                heads, bodies, tail = ids_of([f"{START}{r}\n" for r in roles]), ids_of(texts), ids_of([f"{END}\n"])[0]
                ids = [h + b + tail for h, b in zip(heads, bodies, strict=True)]
                target = [[False] * len(h) + [r == LEARNED] * len(b) + [False] * len(tail) for h, b, r in zip(heads, bodies, roles, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("tie"), pa.array(ids, pa.list_(pa.int32())), pa.array(target, pa.list_(pa.bool_()))], ["conv_id", "turn", "tie", "ids", "target"])

    return given.withColumn("tie", F.sha2(F.concat_ws("\n", "role", "text"), 256)).mapInArrow(encode, "conv_id long, turn long, tie string, ids array<int>, target array<boolean>")


def loss_windows(rows: DataFrame, tokenizer: str, length: int, stride: int) -> DataFrame:
    """conv_id, window, start, ids and labels of the windows (of up to `length` tokens, every `stride` tokens) with something to learn.

    labels hold a token's id where it is learned, else -100. A token that two windows share is learned in the first, so each is learned
    once; windows without a learned token are left out. Turns follow each other by turn, then by a hash of role and text. Turns are
    encoded and cut each by itself; only a window's own tokens are gathered. A conversation's turns are numbered in one task; rows with
    a null conv_id are one conversation.
    """
    if not 0 < stride <= length:
        raise ValueError("stride must be from 1 to length")
    order = Window.partitionBy("conv_id").orderBy("turn", "tie").rowsBetween(Window.unboundedPreceding, -1)
    turns = written(turn_tokens(rows, tokenizer)).withColumn("n", F.size("ids"))
    placed = turns.withColumn("at", F.coalesce(F.sum("n").over(order), F.lit(0)))
    end = F.col("at") + F.col("n")
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("at") - length) / stride) + 1)
    cut = placed.withColumn("window", F.explode(F.sequence(first, F.floor((end - 1) / stride))))
    begin = F.col("window") * stride
    cut = cut.withColumns({"low": F.greatest("at", begin), "high": F.least(end, begin + length)}).where("high > low")
    skip, take = (F.col("low") - F.col("at") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int")
    seen = F.when(F.col("window") > 0, begin - stride + length).otherwise(F.lit(0))
    parts = cut.withColumns({"ids": F.slice("ids", skip, take), "target": F.slice("target", skip, take), "seen": seen})
    labels = F.zip_with("ids", F.transform("target", lambda t, i: t & (F.col("low") + i >= F.col("seen"))), lambda v, t: F.when(t, v).otherwise(F.lit(IGNORED)))
    pieces = parts.select("conv_id", "window", F.struct("low", "ids", labels.alias("labels")).alias("piece"))
    whole = pieces.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    joined = whole.select("conv_id", "window", (F.col("window") * stride).alias("start"), F.flatten("pieces.ids").alias("ids"), F.flatten("pieces.labels").alias("labels"))
    return joined.where(F.exists("labels", lambda v: v != IGNORED))
