"""Spark-native analytics over personal-payment events (money in paise, calendars in IST)."""
