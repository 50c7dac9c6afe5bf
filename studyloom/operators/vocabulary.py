"""Word lists by day, and the cards made from them."""
from pyspark.sql import functions as F

from studyloom.functions.text import stable_id


def word_calendar(words):
    """``words(day, word, meaning)`` -> days seen, meaning of the latest day; most frequent first.

    A word may come up any number of times on a day, so it is reduced per day before the days are counted.
    """
    per_day = words.groupBy("word", "day").agg(F.min("meaning").alias("meaning"))
    return (per_day.groupBy("word").agg(F.count("*").alias("days"), F.max_by("meaning", "day").alias("meaning"))
            .orderBy(F.desc("days"), "word"))


def word_deck(calendar):
    return calendar.select(stable_id(F.col("word"), 10, "w-").alias("card"), F.col("word").alias("front"), F.col("meaning").alias("back"))


def month_words(words, month):
    return words.where(F.date_format("day", "yyyy-MM") == month)
