"""Mixture-of-experts scoring (R2) and model bundles.

A bundle is a directory: ``manifest`` (one JSON text line written through Spark, so any
filesystem Spark can write works) plus one Spark ML model directory per segment expert.
The manifest carries the expected feature order, the log-target flag and the segment map.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import from_log, to_log
from ..functions.rules import route_rules
from .boosting import ExpertSpec, _SparkMLExpert, fit_expert, predict_segments
from .relational import align_columns
from ..session import checkpoint as _ckpt


@dataclass
class MoEBundle:
    features: list
    models: dict
    log_target: bool = True
    family: str = "gbt"
    meta: dict = field(default_factory=dict)

    def score(self, df: DataFrame, keys, out: str = "prediction") -> DataFrame:
        """R2: align to the expected columns (absent → 0), route by the star / rooms /
        amenity rule, score with the segment's expert, invert the log."""
        keys = list(keys)
        need = [c for c in ("starRating", "numberOfRooms", "total_amenities") if c not in self.features]
        if need:
            raise ValueError(f"routing needs {need} among the expected columns")
        x = df.select(*keys, *[F.col(c) for c in self.features if c in df.columns and c not in keys])
        x = x.select(*keys, *[c for c in x.columns if c not in keys])
        aligned = align_columns(x, keys + self.features, fill=0)
        routed = aligned.withColumn("_segment", route_rules())
        if not df.isStreaming:
            routed = _ckpt(routed)                       # every segment reads it
        p = predict_segments(routed, "_segment", self.models, "_p")
        p = p.withColumn(out, from_log("_p") if self.log_target else F.col("_p"))
        return p.drop("_p")


def fit_moe(df: DataFrame, features, y: str, spec: ExpertSpec | None = None, log_target: bool = True) -> MoEBundle:
    """Segments by the rule (E12); one expert per segment on log1p(y)."""
    spec = spec or ExpertSpec("gbt", {"rounds": 10, "depth": 4})
    d = df.withColumn("_segment", route_rules()).withColumn("_t", to_log(y) if log_target else F.col(y))
    d = d.select("_segment", "_t", *features).persist(StorageLevel.MEMORY_AND_DISK)                 # every segment reads it
    segs = [r[0] for r in d.select("_segment").distinct().collect()]
    models = {s: fit_expert(d.filter(F.col("_segment") == s), features, "_t", spec) for s in segs}
    d.unpersist()
    return MoEBundle(list(features), models, log_target, spec.family, {"params": spec.params})


def save_bundle(spark: SparkSession, bundle: MoEBundle, path: str) -> None:
    manifest = {"kind": "moe", "features": bundle.features, "log_target": bundle.log_target,
                "family": bundle.family, "segments": {}, "meta": bundle.meta}
    for i, (seg, m) in enumerate(sorted(bundle.models.items())):
        sub = f"model_{i}"
        m.model.write().overwrite().save(f"{path}/{sub}")
        manifest["segments"][seg] = {"dir": sub, "class": type(m.model).__name__}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").write.mode("overwrite").text(f"{path}/manifest")


def load_bundle(spark: SparkSession, path: str) -> MoEBundle:
    from pyspark.ml import regression as reg
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    models = {}
    for seg, info in manifest["segments"].items():
        cls = getattr(reg, info["class"])
        models[seg] = _SparkMLExpert(manifest["features"], cls.load(f"{path}/{info['dir']}"))
    return MoEBundle(manifest["features"], models, manifest["log_target"], manifest["family"], manifest.get("meta", {}))


def save_flat_stack(spark: SparkSession, stack, path: str) -> None:
    """S8 for the flat stack: base models as Spark ML directories; PCA (means, sds,
    components) and meta coefficients in the manifest, with the log-target flag."""
    manifest = {"kind": "flat_stack", "features": stack.features, "log_target": stack.log_target,
                "bases": {}, "pca": {"features": stack.pca.features, "mean": list(map(float, stack.pca.mean)),
                                     "sd": list(map(float, stack.pca.sd)),
                                     "components": [list(map(float, c)) for c in stack.pca.components],
                                     "prefix": stack.pca.prefix},
                "meta": {"features": stack.meta.features, "coef": list(map(float, stack.meta.coef)),
                         "intercept": float(stack.meta.intercept)}}
    for i, (name, m) in enumerate(stack.bases.items()):
        sub = f"base_{i}"
        m.model.write().overwrite().save(f"{path}/{sub}")
        manifest["bases"][name] = {"dir": sub, "class": type(m.model).__name__}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").write.mode("overwrite").text(f"{path}/manifest")


def load_flat_stack(spark: SparkSession, path: str):
    import numpy as np
    from pyspark.ml import regression as reg
    from .linear import LinearModel
    from .pca import ScaledPCAModel
    from .stacking import FlatStack
    mf = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    bases = {name: _SparkMLExpert(mf["features"], getattr(reg, b["class"]).load(f"{path}/{b['dir']}"))
             for name, b in mf["bases"].items()}
    p = mf["pca"]
    pca = ScaledPCAModel(p["features"], np.array(p["mean"]), np.array(p["sd"]), np.array(p["components"]),
                         np.zeros(len(p["components"])), p["prefix"])
    meta = LinearModel(mf["meta"]["features"], np.array(mf["meta"]["coef"]), mf["meta"]["intercept"])
    return FlatStack(bases, pca, meta, mf["features"], mf["log_target"])
