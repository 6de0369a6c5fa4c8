"""Boxes on a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.functions.spans import NO_PAGES, append, let

# --- fixed values: tolerance between boxes and widening of an applied box ---
TOLERANCE, WIDEN = 2.0, 1.0


def bbox_overlap(items: DataFrame) -> DataFrame:
    """Greedy placement per page in reading order: an item whose box touches an applied box is skipped.

    Needs doc_id, page_num, item_id and bx0..by1; gives applied (boolean) per item. Items are
    gathered per page, which one sheet of paper bounds. Items come from top to bottom, so an applied box
    that ends above an item meets no later one either: an item is compared with the boxes still in reach.
    """
    box = "struct<by0:double,bx0:double,bx1:double,by1:double,item_id:string>"
    reach = f"filter(a.reach, k -> k.by1 >= i.by0 - {TOLERANCE})"
    touches = f"""exists(near, k -> NOT (i.bx1 + {TOLERANCE} < k.bx0 - {WIDEN} OR i.bx0 - {TOLERANCE} > k.bx1 + {WIDEN}
        OR i.by1 + {TOLERANCE} < k.by0 OR i.by0 - {TOLERANCE} > k.by1))"""
    step = let(
        reach, "near",
        let(f"coalesce({touches}, false)", "hit", f"struct(IF(hit, near, concat(near, array(i))) AS reach, {append('a.pages', 'a.page', 'IF(hit, 0, 1)')})"),
    )
    fold = f"""aggregate(items, struct(cast(array() AS array<{box}>) AS reach, {NO_PAGES}), (a, i) -> {step},
        a -> flatten(concat(a.pages, array(a.page))))"""
    per_page = (
        items.groupBy("doc_id", "page_num")
        .agg(F.array_sort(F.collect_list(F.struct("by0", "bx0", "bx1", "by1", F.col("item_id")))).alias("items"))
        .withColumn("kept", F.expr(fold))
    )
    each = F.explode(F.expr("arrays_zip(items.item_id, kept)").cast("array<struct<item_id:string,kept:int>>"))
    return per_page.select("doc_id", "page_num", each.alias("i")).select(
        "doc_id", "page_num", "i.item_id", (F.col("i.kept") == 1).alias("applied")
    )
