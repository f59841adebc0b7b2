"""Listing orders (T1).  The oracle comparison is order-insensitive, so the
orders the reference returns are checked here."""

from fareflow.plans.catalog import QUERIES

from .conftest import SMALL


def _rows(spark, name, *cols):
    return [tuple(r[c] for c in cols) for r in QUERIES[name](spark, SMALL).select(*cols).collect()]


def test_booking_history_user_then_newest_booking(spark):
    got = _rows(spark, "booking_history", "user_id", "booking_id")
    assert got == sorted(got, key=lambda x: (x[0], -x[1])) and len(got) > 0


def test_faq_list_by_category_then_id(spark):
    got = _rows(spark, "faq_list", "category", "id")
    assert got == sorted(got) and len(got) > 0


def test_faq_categories_sorted(spark):
    got = _rows(spark, "faq_category_counts", "category")
    assert got == sorted(got)


def test_listings_newest_first(spark):
    for name in ("filter_listing", "partner_commissions", "refund_listing", "refund_commission_report"):
        got = [r[0] for r in _rows(spark, name, "created_at")]
        assert got == sorted(got, reverse=True) and len(got) > 0, name
