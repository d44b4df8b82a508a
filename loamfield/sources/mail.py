"""E-mail and Markdown contents as section rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamfield.sources import parsers

SECTIONS = "path string, place int, heading string, level int, text string"


def mails(files: DataFrame) -> DataFrame:
    """path, place, heading, level, text of RFC 822 messages in ``files`` (path, content), as :func:`parsers.mail` reads them.
    Null contents have no sections."""

    def run(batches):
        for b in batches:
            rows = [(path, i, s.heading, s.level, s.text) for path, content in zip(b["path"], b["content"], strict=True) if content is not None for i, s in enumerate(parsers.mail(content))]
            yield pd.DataFrame(rows, columns=["path", "place", "heading", "level", "text"]).astype({"level": "Int32", "place": "int32"})

    return files.select("path", "content").mapInPandas(run, SECTIONS)


def markdown(files: DataFrame) -> DataFrame:
    """path, place, heading, level, text: a section for each ``#`` heading, and one for what stands before the first."""
    part = F.posexplode(F.split(F.concat(F.lit("\n"), F.decode("content", "UTF-8")), r"\n(?=#{1,6} )"))
    s = files.select("path", part.alias("place", "s"))
    mark = F.regexp_extract("s", r"^(#{1,6}) ", 1)
    heading = F.when(F.length(mark) > 0, F.trim(F.regexp_extract("s", r"^#{1,6} ([^\n]*)", 1)))
    text = F.trim(F.regexp_replace(F.regexp_replace("s", r"^#{1,6} [^\n]*", ""), r"^\s+|\s+$", ""))
    s = s.select("path", "place", heading.alias("heading"), F.when(F.length(mark) > 0, F.length(mark)).alias("level"), text.alias("text"))
    return s.filter("heading is not null or text <> ''")
