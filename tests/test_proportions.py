"""Every proportion of an item is a row of its own."""

from plumbline.plans import queries as Q


def test_every_ratio_of_every_item_is_returned(spark):
    sf = "/root/testdata/sf0.001"
    found = Q.proportion_features(spark, sf).select("vec_id", "ratio").distinct().count()
    assert found == 171 * 12 * Q._read(spark, sf, "embeddings").count()
