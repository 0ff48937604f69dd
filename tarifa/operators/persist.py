"""One interface to save and load every fitted model.

A model is a folder: ``manifest`` (one JSON line, written through Spark, so any store Spark can
write will do) and, where it has them, Spark ML models and sub-models in folders beside it.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

from .boosting import TweedieGBTModel, _SparkMLExpert
from .forest import PackedForest
from .linear import LinearModel
from .pca import ScaledPCAModel
from .routing import BestFirstRouter
from .scoring import MoEBundle
from .stacking import FlatStack, ForestStack, RoutedStack


def _write(spark: SparkSession, path: str, manifest: dict) -> None:
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def _parts(spark: SparkSession, models: dict, path: str, name: str) -> dict:
    """Save named sub-models; returns name → folder."""
    folders = {str(k): f"{name}_{i}" for i, k in enumerate(sorted(models, key=str))}
    for k, m in models.items():
        save_model(spark, m, f"{path}/{folders[str(k)]}")
    return folders


def save_model(spark: SparkSession, model, path: str) -> None:
    """Save a Spark ML expert, boosted Tweedie or median trees, a packed forest, a linear model, scaled PCA, the best-first
    router, a flat stack, a routed stack (of either kind) or a mixture of experts below ``path``."""
    if isinstance(model, _SparkMLExpert):
        model.model.write().overwrite().save(f"{path}/ml")
        out = {"kind": "ml", "class": type(model.model).__name__, "features": model.features}
    elif isinstance(model, TweedieGBTModel):
        for i, (tree, _) in enumerate(model.trees):
            tree.write().overwrite().save(f"{path}/tree_{i}")
        out = {"kind": "boosted", "features": model.features, "f0": model.f0, "step": model.step, "link": model.link,
               "leaves": [[[float(k), float(v)] for k, v in values.items()] for _, values in model.trees]}
    elif isinstance(model, LinearModel):
        out = {"kind": "linear", "features": model.features, "coef": [float(w) for w in model.coef], "intercept": float(model.intercept)}
    elif isinstance(model, ScaledPCAModel):
        out = {"kind": "pca", "features": model.features, "mean": model.mean.tolist(), "sd": model.sd.tolist(),
               "components": model.components.tolist(), "explained": np.asarray(model.explained).tolist(), "prefix": model.prefix}
    elif isinstance(model, BestFirstRouter):
        out = {"kind": "router", "features": model.features, "fill": model.fill, "prefix": model.prefix, "leaves": model.leaves,
               "leaf_ids": model.leaf_ids, "max_leaves": model.max_leaves, "min_leaf": model.min_leaf, "bins": model.bins}
    elif isinstance(model, FlatStack):
        out = {"kind": "flat", "features": model.features, "log_target": model.log_target, "bases": _parts(spark, model.bases, path, "base"),
               "order": list(model.bases)}
        save_model(spark, model.pca, f"{path}/pca")
        save_model(spark, model.meta, f"{path}/meta")
    elif isinstance(model, RoutedStack):
        out = {"kind": "routed", "features": model.features, "leaves": [int(x) for x in model.leaves], "params": model.params,
               "local": {name: _parts(spark, models, path, f"local_{name}") for name, models in model.local.items()},
               "metas": _parts(spark, model.metas, path, "meta"), "order": list(model.metas)}
        save_model(spark, model.router, f"{path}/router")
        save_model(spark, model.glob, f"{path}/global")
    elif isinstance(model, PackedForest):
        model.save(spark, f"{path}/forest")
        out = {"kind": "forest"}
    elif isinstance(model, ForestStack):
        out = {"kind": "forest_stack", "features": model.features, "leaves": [int(x) for x in model.leaves], "params": model.params,
               "metas": _parts(spark, model.metas, path, "meta"), "order": list(model.metas)}
        save_model(spark, model.router, f"{path}/router")
        save_model(spark, model.forest, f"{path}/experts")
    elif isinstance(model, MoEBundle):
        out = {"kind": "moe", "features": model.features, "log_target": model.log_target, "family": model.family, "meta": model.meta,
               "models": _parts(spark, model.models, path, "expert")}
    else:
        raise TypeError(f"cannot save a {type(model).__name__}")
    _write(spark, path, out)


def load_model(spark: SparkSession, path: str):
    """The model that ``save_model`` wrote below ``path``."""
    from pyspark.ml import regression

    m = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    kind = m["kind"]
    part = lambda folders: {k: load_model(spark, f"{path}/{f}") for k, f in folders.items()}
    if kind == "ml":
        return _SparkMLExpert(m["features"], getattr(regression, m["class"]).load(f"{path}/ml"))
    if kind == "boosted":
        trees = [(regression.DecisionTreeRegressionModel.load(f"{path}/tree_{i}"), {k: v for k, v in leaves}) for i, leaves in enumerate(m["leaves"])]
        return TweedieGBTModel(m["features"], m["f0"], m["step"], trees, [], m["link"])
    if kind == "linear":
        return LinearModel(m["features"], np.array(m["coef"]), m["intercept"])
    if kind == "pca":
        return ScaledPCAModel(m["features"], np.array(m["mean"]), np.array(m["sd"]), np.array(m["components"]), np.array(m["explained"]), m["prefix"])
    if kind == "router":
        r = BestFirstRouter(m["features"], m["max_leaves"], m["min_leaf"], m["bins"], m["fill"], m["prefix"])
        r.leaves, r.leaf_ids = [[tuple(c) for c in conj] for conj in m["leaves"]], m["leaf_ids"]
        return r
    if kind == "flat":
        bases = part(m["bases"])
        return FlatStack({k: bases[k] for k in m["order"]}, load_model(spark, f"{path}/pca"), load_model(spark, f"{path}/meta"), m["features"], m["log_target"])
    if kind == "routed":
        metas = part(m["metas"])
        return RoutedStack(m["features"], load_model(spark, f"{path}/router"), {name: part(f) for name, f in m["local"].items()},
                           load_model(spark, f"{path}/global"), {k: metas[k] for k in m["order"]}, m["leaves"], None, m["params"])
    if kind == "forest":
        return PackedForest.load(spark, f"{path}/forest")
    if kind == "forest_stack":
        metas = part(m["metas"])
        return ForestStack(m["features"], load_model(spark, f"{path}/router"), load_model(spark, f"{path}/experts"),
                           {k: metas[k] for k in m["order"]}, m["leaves"], None, m["params"])
    if kind == "moe":
        return MoEBundle(m["features"], part(m["models"]), m["log_target"], m["family"], m["meta"])
    raise ValueError(f"unknown model kind {kind!r}")
