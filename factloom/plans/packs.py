"""English with the names and events of the queries' own sentences."""

from dataclasses import replace

from factloom.functions import locale

ENGLISH = replace(locale.ENGLISH, foreign=("NATION_3", "NATION_7", "NATION_11"), events={"pandemic": 2020, "merger": 1999}, event_since=r"since the (pandemic|merger)")
