import pytest

from sieveline import storage
from sieveline.operators import labelling

LONG = "one two three four five six seven eight nine ten"


@pytest.mark.parametrize("rows_sent", [storage.BROADCAST_ROWS, 2])
def test_labels_are_the_same_by_broadcast_and_by_shuffle(spark, monkeypatch, rows_sent):
    monkeypatch.setattr(storage.fits_broadcast, "__defaults__", (rows_sent, storage.BROADCAST_BYTES))
    names = spark.createDataFrame([("zenit", "SLR"), ("zenit em", "SLR"), ("kiev", "RF"), ("em kiev", "RF"), (LONG, "TLR")], "name string, label string")
    rows = [
        (1, "zenit em", "old"),
        (2, "zenit and kiev", "two things"),
        (3, "zenit zenit", "the same twice"),
        (4, "zenit em kiev", "names that overlap"),
        (5, "a thing", "kiev, then zenit"),
        (6, LONG, ""),
        (7, "zenit", "and kiev"),
        (8, None, None),
        (9, "nothing", "here"),
    ]
    items = spark.createDataFrame(rows, "item_id long, title string, description string")
    got = {r.item_id: r.kb_model for r in labelling.apply_dictionary(items, names).collect()}
    assert got == {1: "zenit em", 2: None, 3: None, 4: None, 5: "kiev", 6: LONG, 7: "zenit", 8: None, 9: None}
