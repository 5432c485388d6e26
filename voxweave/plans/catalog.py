"""The model catalog: backbones by family, segmentors with the families they accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of backbones by family, and families by segmentor.
BACKBONES = {
    "convnext": "convnext_tiny convnext_small convnext_base convnext_large convnext_xlarge convnext_v2_atto convnext_v2_femto convnext_v2_pico convnext_v2_nano convnext_v2_tiny convnext_v2_small convnext_v2_base convnext_v2_large convnext_v2_huge",
    "densenet": "densenet121 densenet169 densenet201 densenet264",
    "efficientnet": "efficientnet_b0 efficientnet_b1 efficientnet_b2 efficientnet_b3 efficientnet_b4 efficientnet_b5 efficientnet_b6 efficientnet_b7 efficientnet_b8 efficientnet_l2 efficientnet_v2_b0 efficientnet_v2_b1 efficientnet_v2_b2 efficientnet_v2_b3 efficientnet_v2_s efficientnet_v2_m efficientnet_v2_l",
    "mit": "mit_b0 mit_b1 mit_b2 mit_b3 mit_b4 mit_b5",
    "resnet": "resnet18 resnet34 resnet50 resnet101 resnet152 resnet50_v2 resnet101_v2 resnet152_v2 resnet50_vd resnet200_vd resnext50 resnext101",
    "senet": "seresnet18 seresnet34 seresnet50 seresnet50_v2 seresnet50_vd seresnet101 seresnet101_v2 seresnet152 seresnet152_v2 seresnet200_vd seresnext50 seresnext101",
    "swin": "swin_tiny swin_small swin_base swin_tiny_v2 swin_small_v2 swin_base_v2",
    "unetr_plusplus": "unetr_plusplus_encoder",
    "vit": "vit_base vit_large vit_huge",
    "xception": "xception",
}
SEGMENTORS = {
    "attention_unet": "resnet densenet efficientnet convnext senet xception",
    "deeplabv3plus": "resnet densenet efficientnet convnext senet",
    "segformer": "mit",
    "swin_unetr": "swin",
    "trans_unet": "densenet resnet efficientnet senet xception",
    "unet": "resnet densenet efficientnet convnext senet xception",
    "unet_plus_plus": "resnet densenet efficientnet convnext senet xception",
    "unetr": "vit",
    "unetr_plusplus": "unetr_plusplus",
    "upernet": "resnet densenet efficientnet convnext senet xception swin mit",
}


def backbones(spark: SparkSession) -> DataFrame:
    """(name, family array)."""
    return spark.createDataFrame([(n, [f]) for f, names in BACKBONES.items() for n in names.split()], "name string, family array<string>")


def segmentors(spark: SparkSession) -> DataFrame:
    """(name, allowed_families array)."""
    return spark.createDataFrame([(n, f.split()) for n, f in SEGMENTORS.items()], "name string, allowed_families array<string>")


def by_family(spark: SparkSession, family: str | None = None) -> DataFrame:
    """(family, backbones, segmentors): a full outer join of both sides, names sorted."""
    b = backbones(spark).select(F.explode("family").alias("family"), "name").groupBy("family").agg(F.array_join(F.sort_array(F.collect_set("name")), " ").alias("backbones"))
    s = segmentors(spark).select(F.explode("allowed_families").alias("family"), "name").groupBy("family").agg(F.array_join(F.sort_array(F.collect_set("name")), " ").alias("segmentors"))
    out = b.join(s, "family", "full_outer")
    return out if family is None else out.where(F.lower("family") == family.lower())


def lookup(spark: SparkSession, name: str) -> tuple[str, list[str]]:
    """(kind, families) of a name in any case; KeyError lists what there is."""
    found = [("backbone", r.family) for r in backbones(spark).where(F.col("name") == name.lower()).collect()]
    found += [("segmentor", r.allowed_families) for r in segmentors(spark).where(F.col("name") == name.lower()).collect()]
    if not found:
        raise KeyError(f"no {name!r}; there are {sorted([*' '.join(BACKBONES.values()).split(), *SEGMENTORS])}")
    return found[0]


def compatible(spark: SparkSession) -> DataFrame:
    """(segmentor, encoder): encoders all of whose families a segmentor allows."""
    b = backbones(spark).withColumnRenamed("name", "encoder").withColumn("key", F.explode("family"))
    s = segmentors(spark).withColumnRenamed("name", "segmentor").withColumn("key", F.explode("allowed_families"))
    ok = b.join(s, "key").where(F.size(F.array_except("family", "allowed_families")) == 0)
    return ok.select("segmentor", "encoder").distinct()
