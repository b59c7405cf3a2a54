"""Calendar of named Sundays as a generated dimension, one year after the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import dates as D

#: Names by days from Easter, and by weeks from the first Sunday of Advent.
FROM_EASTER = (
    (-42, "1st_Sunday_of_Lent"), (-35, "2nd_Sunday_of_Lent"), (-28, "3rd_Sunday_of_Lent"), (-21, "4th_Sunday_of_Lent"), (-14, "5th_Sunday_of_Lent"), (-7, "Palm_Sunday"),
    (7, "2nd_Sunday_of_Easter_-_Divine_Mercy_Sunday"), (14, "3rd_Sunday_of_Easter"), (21, "4th_Sunday_of_Easter"), (28, "5th_Sunday_of_Easter"), (35, "6th_Sunday_of_Easter"),
    (42, "7th_Sunday_of_Easter"), (49, "Pentecost_Sunday"), (56, "Trinity_Sunday"), (63, "The_Most_Holy_Body_and_Blood_of_Christ"),
)
FROM_ADVENT = ((-7, "Our_Lord_Jesus_Christ_King_of_the_Universe"), (0, "1st_Sunday_of_Advent"), (7, "2nd_Sunday_of_Advent"), (14, "3rd_Sunday_of_Advent"), (21, "4th_Sunday_of_Advent"))
ORDINARY, SIXTH = "_Sunday_in_Ordinary_Time", "Sixth_Sunday_in_Ordinary_Time"
LAST_WEEK = 33


def _ordinary(week: Column) -> Column:
    return F.when(week == 6, SIXTH).otherwise(F.concat(D.ordinal(week), F.lit(ORDINARY)))


def named_sundays(years: DataFrame) -> DataFrame:
    """``year, day, name``. Where two rules name a day the higher rank counts.

    Ordinary weeks before Lent count up from the second; those after it count back from the last week before
    the year's end, and give way to any other name.
    """
    day = lambda m, d: F.make_date("year", F.lit(m), F.lit(d))
    a = years.select(F.col("year").cast("int").alias("year")).where("year IS NOT NULL").distinct()
    a = a.withColumns({"_easter": D.easter(F.col("year")), "_epiphany": D.coming_sunday(day(1, 2)), "_advent": D.coming_sunday(day(11, 27)), "_family": D.coming_sunday(day(12, 26))})
    row = lambda d, n, r: F.struct(d.alias("day"), n.alias("name"), F.lit(r).alias("rank"))
    weeks = lambda first, last, start, r: F.when(first < last, F.transform(F.sequence(first, F.date_sub(last, 1), F.expr("INTERVAL 7 DAYS")), lambda d, i: row(d, _ordinary(start + i), r)))
    before_first, lent = F.date_add("_epiphany", 14), F.date_sub("_easter", 42)
    after_first, king = F.date_add("_easter", 70), F.date_sub("_advent", 7)
    n = F.ceil(F.datediff(king, after_first) / 7).cast("int")
    saints = day(11, 1)
    fixed = [
        row(F.col("_epiphany"), F.lit("Epiphany_of_the_Lord"), 1), row(F.date_add("_epiphany", 7), F.lit("Baptism_of_the_Lord"), 2),
        *[row(F.date_add("_easter", o), F.lit(name), 4) for o, name in FROM_EASTER], row(F.col("_easter"), F.concat(F.lit("Easter_Sunday_"), F.col("year").cast("string")), 4),
        row(F.when(F.dayofweek(saints) == 1, saints), F.lit("All_Saints_Day"), 5), *[row(F.date_add("_advent", o), F.lit(name), 6) for o, name in FROM_ADVENT],
        row(day(12, 25), F.lit("Christmas_Day"), 7), row(F.when(F.year("_family") == F.col("year"), F.col("_family")).otherwise(day(12, 30)), F.lit("The_Holy_Family"), 8),
    ]
    none = F.array().cast("array<struct<day:date,name:string,rank:int>>")
    every = F.concat(F.array(*fixed), F.coalesce(weeks(before_first, lent, F.lit(2), 3), none), F.coalesce(weeks(after_first, king, F.lit(LAST_WEEK + 1) - n, 0), none))
    out = a.select("year", F.explode(every).alias("e")).where("e.day IS NOT NULL")
    return out.groupBy("year", F.col("e.day").alias("day")).agg(F.max_by("e.name", "e.rank").alias("name"))
