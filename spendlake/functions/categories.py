"""Spending categories, and which of them are essential or fit for a joke."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The taxonomy, in order.
CATEGORIES = ["FOOD_DELIVERY", "DINING_OUT", "QUICK_COMMERCE_SNACKS", "GROCERIES", "SHOPPING", "ENTERTAINMENT", "SUBSCRIPTIONS", "TRAVEL", "TRANSPORT", "BILLS_UTILITIES", "RENT", "HEALTH", "EDUCATION", "TRANSFERS", "CASH_UNCATEGORIZED", "OTHER"]
ESSENTIAL = ["GROCERIES", "TRANSPORT", "BILLS_UTILITIES", "RENT", "HEALTH", "EDUCATION"]
#: Categories on which a roast is allowed as such.
ROASTABLE = ["FOOD_DELIVERY", "DINING_OUT", "QUICK_COMMERCE_SNACKS", "SHOPPING", "ENTERTAINMENT", "TRAVEL"]


def is_essential(category: Column) -> Column:
    return F.coalesce(category.isin(ESSENTIAL), F.lit(False))


def is_roastable(category: Column) -> Column:
    return F.coalesce(category.isin(ROASTABLE), F.lit(False))
