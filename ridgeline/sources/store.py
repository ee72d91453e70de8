"""Saved models: a folder with metadata.json (kind, version, settings), arrays, and Parquet tables for what is as long as a vocabulary; bundles of several."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ridgeline.containers import hcat, to_wide
from ridgeline.operators.decide import Decider
from ridgeline.operators.gazetteer import Gazetteer
from ridgeline.operators.kernel import Encoder, Ridge
from ridgeline.operators.matcher import Matcher
from ridgeline.operators.onehot import OneHot
from ridgeline.operators.retrieval import Index
from ridgeline.operators.tokenizer import FittedTokenizer, Tokenizer
from ridgeline.operators.weights import scaled
from ridgeline.plans.search import Block, tokenize_blocks

VERSION = 2


#: Bytes of an array in one row.
PIECE = 8 << 20


def _write(spark: SparkSession, path: str, kind: str, settings: dict, tables: dict[str, DataFrame], arrays: dict[str, np.ndarray] | None = None) -> None:
    """Through Hadoop's file systems, so that the path may be on any of them. Arrays are a table of binary pieces."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")
    held = {}
    for name, x in (arrays or {}).items():
        held[name] = {"shape": list(x.shape), "dtype": x.dtype.str}
        raw = memoryview(np.ascontiguousarray(x)).cast("B") if x.size else b""
        rows = [(i, bytes(raw[at : at + PIECE])) for i, at in enumerate(range(0, len(raw), PIECE))]
        spark.createDataFrame(rows, "i int, data binary").write.mode("overwrite").parquet(f"{path}/{name}")
    meta = {"kind": kind, "version": VERSION, "arrays": held} | settings
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata.json")


def _arrays(spark: SparkSession, path: str, meta: dict) -> dict[str, np.ndarray]:
    out = {}
    for name, a in meta["arrays"].items():
        rows = sorted(spark.read.parquet(f"{path}/{name}").toLocalIterator(), key=lambda r: r["i"])
        out[name] = np.frombuffer(b"".join(r["data"] for r in rows), a["dtype"]).reshape(a["shape"]).copy()
    return out


def _read(spark: SparkSession, path: str, kind: str | None = None) -> dict:
    try:
        meta = json.loads(spark.read.text(f"{path}/metadata.json").first()[0])
    except ValueError as e:
        raise ValueError(f"{path} holds no model") from e
    if meta.get("version") != VERSION or (kind and meta.get("kind") != kind):
        raise ValueError(f"{path} holds {meta.get('kind')} version {meta.get('version')}, not {kind or 'a model'} version {VERSION}")
    return meta


def save(model, path: str, spark: SparkSession) -> None:
    if isinstance(model, FittedTokenizer):
        t = asdict(model.tokenizer)
        _write(spark, path, "tokenizer", {"settings": {k: v for k, v in t.items() if k != "markers"}}, {"vocab": model.vocab})
    elif isinstance(model, Matcher):
        s = {"patterns": [base64.b64encode(p).decode() for p in model.patterns], "priorities": model.priorities, "names": model.names, "normalize": model.normalize}
        _write(spark, path, "matcher", s, {})
    elif isinstance(model, Decider):
        _write(spark, path, "decider", asdict(model), {})
    elif isinstance(model, Ridge):
        _write(spark, path, "ridge", {}, {}, {"w": model.w, "b": model.b})
    elif isinstance(model, Encoder):
        arrays = {"z": model.z, "inverse": model.inverse} | ({} if model.columns is None else {"columns": model.columns})
        _write(spark, path, "encoder", {"name": model.kind, "nu": model.nu, "gamma": model.gamma}, {}, arrays)
    elif isinstance(model, OneHot):
        _write(spark, path, "onehot", {"categorical": model.categorical, "continuous": model.continuous}, {"bits": model.bits})
    elif isinstance(model, Gazetteer):
        _write(spark, path, "gazetteer", {"n_types": model.n_types, "ngrams": model.ngrams}, {"counts": model.counts})
    elif isinstance(model, Index):
        _write(spark, path, "index", {"key": model.key, "code": model.code, "dims": model.dims, "rerank": model.can_rerank}, {"corpus": model.corpus})
    else:
        raise TypeError(f"no form for {type(model).__name__}")


def load(path: str, spark: SparkSession, kind: str | None = None):
    """The model saved at path. A folder without metadata, of another kind or version is an error."""
    m = _read(spark, path, kind)
    table: Callable[[str], DataFrame] = lambda name: spark.read.parquet(f"{path}/{name}")
    match m["kind"]:
        case "tokenizer":
            return FittedTokenizer(Tokenizer(**m["settings"]), table("vocab"))
        case "matcher":
            return Matcher(tuple(base64.b64decode(p) for p in m["patterns"]), m["priorities"] and tuple(m["priorities"]), m["names"] and tuple(m["names"]), m["normalize"])
        case "decider":
            return Decider(**{k: m[k] for k in ("n_labels", "mode", "reject", "offset")})
        case "ridge":
            return Ridge(**_arrays(spark, path, m))
        case "encoder":
            x = _arrays(spark, path, m)
            return Encoder(x["z"], x["inverse"], m["name"], m["nu"], m["gamma"], x.get("columns"))
        case "onehot":
            return OneHot(m["categorical"], m["continuous"], table("bits"))
        case "gazetteer":
            return Gazetteer(table("counts"), m["n_types"], m["ngrams"] and tuple(m["ngrams"]))
        case "index":
            x = Index.__new__(Index)
            x.key, x.code, x.dims, x.can_rerank, x.corpus = m["key"], m["code"], m["dims"], m["rerank"], table("corpus")
            return x
        case other:
            raise ValueError(f"no model of kind {other}")


@dataclass
class Bundle:
    """What it takes to decide on new texts: tokenizers with the weights (col, w) of their columns, one encoder and ridge for each seed, a decider,
    and a gazetteer with the scales (col, w) of its columns."""

    tokenizers: list
    encoders: list
    ridges: list
    decider: Decider | None = None
    gazetteer: Gazetteer | None = None
    weighing: list[DataFrame] | None = None
    gaz_rms: DataFrame | None = None

    def encode(self, texts: DataFrame, focus: DataFrame | None = None, tokens=None, cand: DataFrame | None = None, i: int = 0) -> DataFrame:
        """(row, code) of new texts, or of their focus spans (doc_id, idx, s, e, row), by the encoder i. cand: (doc_id, s, e, row) of what the gazetteer describes.
        Rows without any known feature have none."""
        _, blocks = tokenize_blocks([t.tokenizer for t in self.tokenizers], texts, self.tokenizers, focus, tokens)
        if self.gazetteer is not None and cand is not None:
            g = self.gazetteer.block(texts, cand.drop("row")).join(cand.select("doc_id", "s", "e", "row"), ["doc_id", "s", "e"]).select("row", "col", "val")
            blocks = [*blocks, Block(scaled(g, self.gaz_rms) if self.gaz_rms is not None else g, self.gazetteer.n_types)]
        given = self.weighing or []
        x = hcat([(scaled(b.x, given[k]) if k < len(given) else b.x, b.n_cols) for k, b in enumerate(blocks)])
        return self.encoders[i].encode_wide(to_wide(x))

    def save(self, path: str, spark: SparkSession) -> None:
        if len(self.encoders) != len(self.ridges):
            raise ValueError("an encoder for each ridge")
        parts = {f"tokenizer_{i}": t for i, t in enumerate(self.tokenizers)} | {f"encoder_{i}": e for i, e in enumerate(self.encoders)} | {f"ridge_{i}": r for i, r in enumerate(self.ridges)}
        parts |= {k: v for k, v in (("decider", self.decider), ("gazetteer", self.gazetteer)) if v is not None}
        for name, p in parts.items():
            save(p, f"{path}/{name}", spark)
        tables = {f"weights_{i}": w for i, w in enumerate(self.weighing or [])} | ({} if self.gaz_rms is None else {"gaz_rms": self.gaz_rms})
        _write(spark, path, "bundle", {"parts": list(parts), "tables": list(tables)}, tables)

    @staticmethod
    def load(path: str, spark: SparkSession) -> "Bundle":
        meta = _read(spark, path, "bundle")
        names, tables = meta["parts"], meta["tables"]
        of = lambda prefix: [load(f"{path}/{n}", spark) for n in names if n.startswith(prefix)]
        weighing = [spark.read.parquet(f"{path}/{t}") for t in tables if t.startswith("weights_")]
        rms = spark.read.parquet(f"{path}/gaz_rms") if "gaz_rms" in tables else None
        return Bundle(of("tokenizer_"), of("encoder_"), of("ridge_"), next(iter(of("decider")), None), next(iter(of("gazetteer")), None), weighing or None, rms)
