"""Label sets, business constants and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# The label domain, its order, and the limits of the decision rules.
MAIN_SET = ["SLR", "TLR", "rangefinder_viewfinder", "compact_point_and_shoot", "instant"]
ABSTAIN = "other_unknown"
ALL_LABELS = [*MAIN_SET, ABSTAIN]
VALID_STATUS = "valid_single_film_camera"
STATUSES = [
    VALID_STATUS,
    "multi_camera_lot",
    "accessory_or_part",
    "film_or_consumable",
    "digital_camera",
    "box_manual_packaging",
    "not_camera",
    "insufficient_info",
    "image_unavailable",
    "conflicting_evidence",
]
AER_CAP = 0.05
Z = 1.96
Z2 = 3.8416
DEMOTE_AT = 0.85
TRUST_AT = 0.7
MIN_KEY_CHARS = 40
MIN_RARE_ROWS = 30
SPLIT_SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}
SEED = 42

RESPONSE = T.StructType(
    [
        T.StructField("object_status", T.StringType()),
        T.StructField("body_type", T.StringType()),
        T.StructField("final_label", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

ITEMS = T.StructType(
    [
        T.StructField("item_id", T.StringType(), False),
        T.StructField("user_id", T.StringType()),
        T.StructField("microcat_name", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("image_id", T.LongType()),
    ]
)

PREDICTIONS = T.StructType(
    [T.StructField("item_id", T.StringType(), False), T.StructField("pred_label", T.StringType()), T.StructField("confidence", T.DoubleType())]
    + [T.StructField(f"p_{c}", T.DoubleType()) for c in ALL_LABELS]
)
