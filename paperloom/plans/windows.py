"""Query of token windows with loss masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from . import fixtures as X
from .registry import query


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def loss_windows(spark, sf_dir):
    """Windows of 256 tokens every 192 over all conversations: how many tokens, how many learned, and hashes of both."""
    found = W.loss_windows(X.table(spark, sf_dir, "conversations"), vocabulary(), 256, 192)
    learned = F.filter("labels", lambda v: v != W.IGNORED)
    text = lambda c: F.sha2(F.array_join(F.transform(c, lambda v: v.cast("string")), ","), 256)
    return found.select("conv_id", "window", "start", F.size("ids").alias("n_tokens"), F.size(learned).alias("n_learned"), text(F.col("ids")).alias("ids_sha256"), text(learned).alias("learned_sha256"))
