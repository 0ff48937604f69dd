"""Rule Columns: segment routing, tier price, segment labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's results.
SEG_LUXURY = "Lujo_Resort"
SEG_BOUTIQUE = "Boutique_Informal"
SEG_STANDARD = "Estandar"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _true(pred: Column) -> Column:
    # NULL-safe: an unknown comparison never routes a row.
    return F.coalesce(pred, F.lit(False))


def route_rules(stars="starRating", rooms="numberOfRooms", amenities="total_amenities") -> Column:
    """Stars ≥ 4.5 or rooms > 300 or amenities > 15 → luxury; else stars < 2 or rooms < 50 →
    boutique; else standard."""
    s, r, a = _c(stars), _c(rooms), _c(amenities)
    return (F.when(_true((s >= 4.5) | (r > 300) | (a > 15)), F.lit(SEG_LUXURY))
            .when(_true((s < 2) | (r < 50)), F.lit(SEG_BOUTIQUE))
            .otherwise(F.lit(SEG_STANDARD)))


def tier_price(stars="starRating", amenities="total_amenities") -> Column:
    """250 + 5a when stars ≥ 4.5; 150 + 4a when stars ≥ 3 and a > 10; else 80 + 3a."""
    s, a = _c(stars), _c(amenities)
    return (F.when(_true(s >= 4.5), 250.0 + a * 5.0)
            .when(_true((s >= 3.0) & (a > 10)), 150.0 + a * 4.0)
            .otherwise(80.0 + a * 3.0))


def segment_label(prefix: str, id_col) -> Column:
    """``Hoja_<leaf>`` / ``Cluster_<k>``."""
    return F.concat(F.lit(f"{prefix}_"), _c(id_col).cast("string"))
