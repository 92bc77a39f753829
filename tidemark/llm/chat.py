"""Chat formatting: multi-party perspective rotation, with DataFrame functions only.

Every participant of a conversation gets its own rendering: that participant's turns are
the assistant's, all other turns those of users named after their speakers. The mask marks
the characters a model is trained on: the content and end marker of the assistant's turns.

Nothing that a participant writes can pass for a marker: ``<|``, and ``<`` and ``|`` with backslashes between them, get one more
backslash there. In names, which stand on a marker's line, backslashes are doubled and line breaks written as ``\\n`` and
``\\r`` before that. Both can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Turns of one row of the result; a longer conversation continues in its next part.
PART_TURNS = 256
#: Roles that set the scene for everybody and are not rotated.
SCENE = ("system",)


#: Turn numbers that are ranked in one task; a conversation with more is ranked by several.
SPAN = 4096


def escaped(text: Column) -> Column:
    """A text that holds no marker: every ``<|`` with k backslashes inside has k + 1 instead."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_name(name: Column) -> Column:
    """A name on one line that holds no marker."""
    one_line = F.replace(F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.replace(one_line, F.lit("<|"), F.lit("<\\|"))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS, scene: tuple[str, ...] = SCENE) -> DataFrame:
    """One row per conversation, participant and part of `part_turns` turns.

    `turns` has conv_id, turn, role, text (others are not looked at). A participant is a distinct
    role that is not null, blank or one of `scene`; a conversation without one gives no rows.
    Scene turns are rendered as such for everyone. A null role is the user ``unknown``, a null text
    is empty, a null conv_id is a conversation of its own. Turns go by (turn, role, text), nulls
    first; repeated rows are all kept. `mask` has [start, end) code points of the rendering of the part;
    `offset` is where the part starts in the whole rendering, so parts joined in order give all of it; what stands at the start of
    a conversation, such as its system turn, is in its first part. An empty table gives an empty result; a text of any length is kept whole.

    No task holds a conversation. Turns are ranked within spans of turn numbers, and spans by their sizes; texts
    are gathered by part; what spans a whole conversation, the offsets, is computed from lengths alone.
    """
    is_scene = F.coalesce(F.col("role").isin(*scene), F.lit(False)) if scene else F.lit(False)
    kind = dict(turns.dtypes)["conv_id"]
    conv = ["c", "lost"]  # the id, and whether it is missing: keys that are never null
    t = turns.select(
        F.coalesce("conv_id", F.lit("0").cast(kind)).alias("c"),
        F.col("conv_id").isNull().alias("lost"),
        F.col("turn").alias("turn"),
        F.coalesce(F.floor(F.col("turn") / SPAN).cast("long"), F.lit(-(1 << 62))).alias("span"),
        F.coalesce("role", F.lit("unknown")).alias("speaker"),
        escaped_name(F.coalesce("role", F.lit("unknown"))).alias("name"),
        escaped(F.coalesce("text", F.lit(""))).alias("body"),
        is_scene.alias("scene"),
        (F.col("role").isNotNull() & (F.trim("role") != "") & ~is_scene).alias("voice"),
    )
    sizes = t.groupBy(*conv, "span").agg(F.count("*").alias("size"))
    before = Window.partitionBy(*conv).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(*conv, "span", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy(*conv, "span").orderBy("turn", "speaker", "body"))
    numbered = t.withColumn("place", place).join(first, [*conv, "span"]).withColumn("n", F.col("first") + F.col("place") - 1)
    numbered = numbered.withColumn("part", F.floor(F.col("n") / part_turns).cast("int"))

    # lengths: of each part for any user, and what a participant's own turns differ by
    length = lambda who: F.when(F.col("scene"), F.char_length(who) + len(OPEN + SEP)).otherwise(F.char_length(who) + len(f"{OPEN}user name={SEP}"))
    spoken = numbered.groupBy(*conv, "part", "speaker", "name", "scene", "voice").agg(F.count("*").alias("many"), F.sum(F.char_length("body") + len(CLOSE)).alias("chars"))
    base = spoken.groupBy(*conv, "part").agg(F.sum(F.col("chars") + F.col("many") * length("name")).alias("base"))
    own = spoken.filter("voice").select(*conv, "part", F.col("speaker").alias("participant"), (F.col("many") * (len(f"{OPEN}assistant{SEP}") - length("name"))).alias("less"))
    voices = own.select(*conv, "participant").distinct()
    sized = base.join(voices, conv).join(own, [*conv, "part", "participant"], "left").withColumn("n_chars", (F.col("base") + F.coalesce("less", F.lit(0))).cast("long"))
    along = Window.partitionBy(*conv, "participant").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.select(*conv, "part", "participant", "n_chars", F.coalesce(F.sum("n_chars").over(along), F.lit(0).cast("long")).alias("offset"))

    parts = numbered.groupBy(*conv, "part").agg(F.array_sort(F.collect_list(F.struct("n", "speaker", "name", "body", "scene"))).alias("items"))
    both = parts.join(sized, [*conv, "part"])

    def head(x: Column) -> Column:
        mine = x["speaker"] == F.col("participant")
        return F.when(x["scene"], F.concat(F.lit(OPEN), x["name"], F.lit(SEP))).when(mine, F.lit(f"{OPEN}assistant{SEP}")).otherwise(F.concat(F.lit(f"{OPEN}user name="), x["name"], F.lit(SEP)))

    rendered = F.array_join(F.transform("items", lambda x: F.concat(head(x), x["body"], F.lit(CLOSE))), "")
    pieces = F.transform("items", lambda x: F.struct(F.char_length(head(x)).alias("h"), (F.char_length(x["body"]) + len(CLOSE)).alias("b"), (~x["scene"] & (x["speaker"] == F.col("participant"))).alias("own")))
    start = F.expr("cast(struct(0L as at, cast(array() as array<struct<start:bigint,end:bigint>>) as mask) as struct<at:bigint,mask:array<struct<start:bigint,end:bigint>>>)")
    walk = F.aggregate(
        "pieces",
        start,
        lambda acc, x: F.struct(
            (acc["at"] + x["h"] + x["b"]).cast("bigint").alias("at"),
            F.when(x["own"], F.concat(acc["mask"], F.array(F.struct((acc["at"] + x["h"]).cast("bigint").alias("start"), (acc["at"] + x["h"] + x["b"]).cast("bigint").alias("end"))))).otherwise(acc["mask"]).alias("mask"),
        ),
    )
    done = both.withColumn("pieces", pieces).withColumn("walk", walk)
    return done.select(
        F.when(~F.col("lost"), F.col("c")).alias("conv_id"),
        "participant",
        "part",
        F.size("items").cast("long").alias("n_turns"),
        F.size("walk.mask").cast("long").alias("n_own"),
        "offset",
        "n_chars",
        rendered.alias("rendered"),
        F.col("walk.mask").alias("mask"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """The rows with the mask as text (``start:end`` joined by commas), which SQL engines print alike."""
    spans = F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string")))
    return formatted.withColumn("mask", F.array_join(spans, ","))
