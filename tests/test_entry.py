import __spark_entry__


def test_entry_calls_a_query_that_exists(spark):
    assert __spark_entry__.entry(spark).count() > 0
