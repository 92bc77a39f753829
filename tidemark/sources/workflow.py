"""Workflows: detector rules and edit rules in two dialects of one schema, as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How the schema id of a workflow ends.
SCHEMA_ENDS = "-workflow-v1"
_ROI = "struct<coordinate_space:string,x1:double,y1:double,x2:double,y2:double>"
_DETECTOR = f"struct<detector_type:string,event_label:string,roi:{_ROI},templates:array<struct<kind:string,file:string>>,positive_samples:array<string>,negative_samples:array<string>,thresholds:map<string,double>>"
#: The union of both dialects: a detector beside the rules, or rules that hold their detector in place.
WORKFLOW = (
    f"`schema` string, game_id string, display_name string, detector {_DETECTOR}, "
    f"rules array<struct<id:string,label:string,type:string,detector:{_DETECTOR},detector_type:string,event_label:string,roi:{_ROI},templates:array<struct<kind:string,file:string>>,thresholds:map<string,double>>>, "
    "edit_rules struct<event_pre_seconds:double,event_post_seconds:double,merge_gap_seconds:double,long_gap_bridge_seconds:double,fade_to_black_seconds:double,allow_early_end:boolean>, "
    "profiles array<struct<profile_id:string,width:int,height:int>>"
)


def parse(df: DataFrame, text: str) -> DataFrame:
    """Adds `workflow`; null for text that is no JSON or has another schema id."""
    w = F.from_json(F.col(text), WORKFLOW)
    return df.withColumn("workflow", w).withColumn("workflow", F.when(F.col("workflow.schema").endswith(SCHEMA_ENDS), F.col("workflow")))


def rules(df: DataFrame, key: str) -> DataFrame:
    """(key, ord, rule_id, label, detector_type, roi, thresholds): the rules of a workflow; a single detector is the rule
    ``rule-1``. Repeated ids get ``-2``, ``-3``, and so on in order."""
    w = F.col("workflow")
    whole = F.struct(F.lit(0).alias("pos"), F.struct(F.lit("rule-1").alias("_id"), w["detector"]["event_label"].alias("label"), w["detector"]["detector_type"].alias("kind"), w["detector"]["roi"].alias("roi"), w["detector"]["thresholds"].alias("thresholds")).alias("r"))
    several = F.transform(
        w["rules"],
        lambda x, i: F.struct(
            i.alias("pos"),
            F.struct(
                x["id"].alias("_id"),
                F.coalesce(x["label"], x["event_label"], x["detector"]["event_label"]).alias("label"),
                F.coalesce(x["detector"]["detector_type"], x["detector_type"], x["type"], F.lit("template_match")).alias("kind"),
                F.coalesce(x["detector"]["roi"], x["roi"]).alias("roi"),
                F.coalesce(x["detector"]["thresholds"], x["thresholds"]).alias("thresholds"),
            ).alias("r"),
        ),
    )
    rows = df.filter("workflow is not null").select(key, F.explode(F.when(F.size(w["rules"]) > 0, several).otherwise(F.array(whole))).alias("e")).select(key, F.col("e.pos").alias("ord"), "e.r.*")
    base = F.coalesce("_id", F.lit("rule"))
    n = F.row_number().over(Window.partitionBy(key, base).orderBy("ord"))
    return rows.withColumn("_n", n).select(key, "ord", F.when(F.col("_n") == 1, base).otherwise(F.concat(base, F.lit("-"), F.col("_n"))).alias("rule_id"), "label", F.col("kind").alias("detector_type"), "roi", "thresholds")


def violations(df: DataFrame, key: str) -> DataFrame:
    """(key, rule): what is wrong with a workflow's rectangles, thresholds and edit rules."""
    from ..operators.selection import violations as broken

    r = rules(df, key).withColumn("what", F.col("rule_id"))
    roi = F.col("roi")
    inside = roi.isNull() | ((roi["x1"] >= 0) & (roi["x1"] < roi["x2"]) & (roi["x2"] <= 1) & (roi["y1"] >= 0) & (roi["y1"] < roi["y2"]) & (roi["y2"] <= 1))
    fine = F.forall(F.map_values(F.coalesce("thresholds", F.create_map().cast("map<string,double>"))), lambda v: v.between(0, 1))
    per_rule = broken(r, {"roi": inside, "space": roi.isNull() | (roi["coordinate_space"] == "normalized"), "thresholds": fine, "label": F.trim(F.coalesce("label", F.lit(""))) != ""}, [key])
    e = F.col("workflow.edit_rules")
    names = ("event_pre_seconds", "event_post_seconds", "merge_gap_seconds", "long_gap_bridge_seconds", "fade_to_black_seconds")
    positive = F.lit(True)
    for n in names:
        positive = positive & (F.coalesce(e[n], F.lit(0.0)) >= 0)
    bridge = F.coalesce(e["long_gap_bridge_seconds"], F.lit(2.0)) <= F.coalesce(e["merge_gap_seconds"], F.lit(2.0))
    return per_rule.unionByName(broken(df.filter("workflow is not null"), {"edit_rules": positive, "bridge": bridge}, [key]))


def export(df: DataFrame, key: str) -> DataFrame:
    """(key, text): the workflow as JSON of the same schema."""
    return df.filter("workflow is not null").select(key, F.to_json("workflow").alias("text"))
