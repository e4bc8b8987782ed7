"""Embedding providers: strategies that turn a column of texts into vectors, and attaching them to spans."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from weft.functions import labels, vectors as V
from weft.runtime import plain_columns

#: A function from a list of texts to an (n, dim) array; it is called in batches, once a worker per partition.
Encoder = Callable[[list[str]], np.ndarray]


@dataclass(frozen=True)
class Provider:
    """``column`` is an expression on the text, or ``load`` gives the encoder inside a worker."""

    model: str
    dim: int
    column: Callable[[Column], Column] | None = None
    load: Callable[[], Encoder] | None = None


def hash_provider(dim: int = 384) -> Provider:
    return Provider(f"hash-{dim}", dim, column=lambda text: V.hash_embedding(text, dim))


def encoder_provider(model: str, dim: int, load: Callable[[], Encoder]) -> Provider:
    """Any encoder: ``load`` runs once for each partition, in its worker, so models are not sent around."""
    return Provider(model, dim, load=load)


def onnx_provider(path: str, tokenizer: str, name: str | None = None) -> Provider:
    """A sentence encoder in ONNX with its tokenizer file, mean-pooled over the attended tokens and scaled
    to length 1. Both files must be at hand on every worker."""
    model, dim = labels.local_model(name)

    def load() -> Encoder:
        import onnxruntime
        from tokenizers import Tokenizer

        session, tok = onnxruntime.InferenceSession(path), Tokenizer.from_file(tokenizer)
        tok.enable_padding()
        tok.enable_truncation(512)
        wanted = {i.name for i in session.get_inputs()}

        def encode(texts: list[str]) -> np.ndarray:
            rows = tok.encode_batch(texts)
            feed = {"input_ids": [r.ids for r in rows], "attention_mask": [r.attention_mask for r in rows], "token_type_ids": [r.type_ids for r in rows]}
            feed = {n: np.array(v, np.int64) for n, v in feed.items() if n in wanted}
            hidden = session.run(None, feed)[0]
            mask = np.array([r.attention_mask for r in rows], np.float32)[:, :, None]
            pooled = (hidden * mask).sum(1) / np.maximum(mask.sum(1), 1e-9)
            return pooled / np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), 1e-12)

        return encode

    return Provider(model, dim, load=load)


def provider(kind: str = "local", model: str | None = None, files: tuple[str, str] | None = None, forbid_fallbacks: bool = False, encoders: dict[str, Provider] | None = None) -> Provider:
    """The provider of a kind: local (ONNX files if given and readable, else the hash), hash, or one that
    the caller has registered (openai, remote, ollama need a network and are given as encoders)."""
    kind = (kind or "local").lower()
    if encoders and kind in encoders:
        return encoders[kind]
    if kind == "local" and files and all(map(os.path.exists, files)):
        return onnx_provider(*files, model)
    if kind == "hash" or kind == "local" and not forbid_fallbacks:
        return hash_provider(labels.local_model(model)[1])
    raise LookupError(f"no encoder for provider {kind!r}")


def embed(rows: DataFrame, text: str, chosen: Provider, into: str = "embedding") -> DataFrame:
    """rows with a vector of each text; null for null texts."""
    rows = rows.drop(into)
    if chosen.column is not None:
        return rows.withColumn(into, F.when(F.col(text).isNotNull(), chosen.column(F.col(text)).cast("array<float>")))
    load, dim = chosen.load, chosen.dim

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for f in frames:
            here = f[text].notna().to_numpy()
            out: list = [None] * len(f)
            if here.any():
                found = np.asarray(encode(f[text][here].tolist()), np.float32)
                if found.shape != (int(here.sum()), dim):
                    raise ValueError(f"the encoder gave {found.shape}, not {(int(here.sum()), dim)}")
                for i, v in zip(np.flatnonzero(here), found):
                    out[i] = v
            yield plain_columns(f).assign(**{into: pd.Series(out, f.index, dtype=object)})

    shape = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{into}` array<float>"
    return rows.mapInPandas(run, shape)


def attach(spans: DataFrame, chosen: Provider) -> DataFrame:
    """spans (id, text, ...) with embedding and model; vectors that are there stay, unless they have
    another length than the provider's."""
    old = spans if "embedding" in spans.columns else spans.withColumn("embedding", F.lit(None).cast("array<float>"))
    old = old if "model" in old.columns else old.withColumn("model", F.lit(None).cast("string"))
    new = embed(old.withColumnRenamed("embedding", "held"), "text", chosen, "fresh")
    keep = V.usable(F.col("held"), chosen.dim)
    return new.withColumn("model", F.when(keep, F.col("model")).when(F.col("fresh").isNotNull(), F.lit(chosen.model))).withColumn("embedding", F.when(keep, F.col("held")).otherwise(F.col("fresh"))).drop("held", "fresh")
