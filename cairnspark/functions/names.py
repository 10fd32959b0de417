"""Entity names and lenient model output: what the built-in functions cannot express, as pandas UDFs."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that decorate a name, and what ends an entity's name.
DECORATION = "「」『』《》【】〔〕〈〉“”‘’„‟«»‹›\"'`•※★☆◆◇●○■□▲△"
ENTITY_SUFFIXES = ("科技", "公司", "相机", "物流", "智能", "大学", "研究所", "研究院", "学院", "奖学金", "协会", "系")
_DROP = str.maketrans("", "", DECORATION)


def normal_name(name: str | None) -> str:
    """K2 for one name: compatibility form, lower case, no decoration, single spaces."""
    return " ".join(unicodedata.normalize("NFKC", name or "").lower().translate(_DROP).split())


@F.pandas_udf(StringType())
def normalize_name(names: pd.Series) -> pd.Series:
    return names.map(normal_name)


def rule_entities(text: Column) -> Column:
    """Names with a telling suffix, and names in corner brackets, sorted."""
    suffixed = F.regexp_extract_all(text, F.lit("([一-鿿]{2,10}(?:" + "|".join(ENTITY_SUFFIXES) + "))"), F.lit(1))
    quoted = F.regexp_extract_all(text, F.lit("[「『]([^」』]{2,12})[」』]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(suffixed, quoted)))


def capital_entities(text: Column) -> Column:
    """N1's default for Latin texts: distinct capitalised words of six letters or more."""
    return F.array_sort(F.array_distinct(F.filter(F.split(text, r"[\s\p{P}]+"), lambda w: w.rlike("^[A-Z][a-z]{5,}$"))))


def lenient_json(text: str | None) -> str | None:
    """K6: the first object or array of a model's answer, whatever stands around it."""
    body = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", text or "")
    for at, letter in enumerate(body):
        if letter in "[{":
            try:
                return json.dumps(json.JSONDecoder().raw_decode(body[at:])[0], ensure_ascii=False, sort_keys=True)
            except ValueError:
                continue
    return None


@F.pandas_udf(StringType())
def first_json(texts: pd.Series) -> pd.Series:
    return texts.map(lenient_json)


def confidence(raw: Column) -> Column:
    """K7: within 0 and 1, else 1."""
    c = raw.try_cast("double")
    return F.when(c.isNull() | F.isnan(c), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
