"""A selection that two tables need is made once."""

from unittest import mock

from seqloom.operators import dictionary
from seqloom.plans import mining


def test_selection_is_made_once(spark):
    with mock.patch.object(dictionary, "mutual_information", wraps=dictionary.mutual_information) as made:
        assert mining.sparse_instances(spark, "/root/testdata/sf0.001").count()
    assert made.call_count == 1
