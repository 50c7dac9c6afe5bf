"""Vacancy search: requirement texts against a profile."""
from functools import reduce

from pyspark.sql import functions as F

# Education levels named in requirement texts, in order; Chinese numerals of years.
EDU_LEVEL = [("大专", 1), ("专科", 1), ("本科", 2), ("硕士", 3), ("研究生", 3), ("博士", 4)]
CN_NUM = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6}
UNLIMITED = "不限|无限制|无要求"


def _text(c):
    return F.coalesce(c, F.lit(""))


def edu_ok(req, mine):
    """``mine`` is a Python string (one profile against many vacancies)."""
    level = next((lv for name, lv in EDU_LEVEL if name in (mine or "")), 0)
    if not level:
        return F.lit(True)
    r = _text(req)
    named = F.array_compact(F.array(*[F.when(r.contains(n), lv) for n, lv in EDU_LEVEL]))
    me = F.lit(level)
    return (F.when((r == "") | r.contains("不限") | (F.size(named) == 0), True)
            .when(r.contains("仅限"), F.array_contains(named, me))
            .when(r.contains("以上"), me >= F.array_min(named))
            .when(r.contains("以下"), me <= F.array_max(named))
            .otherwise(F.array_contains(named, me)))


def politics_ok(req, mine):
    r, mine = _text(req), mine or "群众"
    party, league = F.lit("党员" in mine), F.lit("团员" in mine)
    wants_party, wants_league = r.contains("党员"), r.contains("团员")
    return (F.when((r == "") | r.contains("不限"), True).when(wants_party & wants_league, party | league)
            .when(wants_party, party).when(wants_league, league).otherwise(True))


def years_required(req):
    r = _text(req)
    digits = F.regexp_extract(r, r"(?U)(\d+)\s*年", 1)
    cn = F.regexp_extract(r, r"(?U)([一二两三四五六])\s*年", 1)
    words = F.create_map(*[F.lit(x) for kv in CN_NUM.items() for x in kv])
    return (F.when(r.rlike(UNLIMITED), 0).when(digits != "", digits.cast("int"))
            .otherwise(F.coalesce(F.try_element_at(words, cn), F.lit(0)))).cast("bigint")


def project_ok(req, has):
    r = _text(req)
    return (r == "") | r.rlike("不限|无限制") | F.lit(bool(has))


def major_ok(req, majors):
    r, keys = _text(req), [m.strip() for m in majors or [] if m and m.strip()]
    hit = reduce(lambda a, b: a | b, [r.contains(k) for k in keys], F.lit(not keys))
    return (r == "") | r.rlike("不限|无限制") | hit


def blocked_reasons(profile):
    """Array of the requirements the profile fails."""
    tests = [("学历", edu_ok(F.col("edu"), profile.get("edu"))), ("政治面貌", politics_ok(F.col("politics"), profile.get("politics"))),
             ("基层年限", years_required(F.col("years")) <= int(profile.get("years") or 0)),
             ("服务基层项目", project_ok(F.col("project"), profile.get("project"))), ("专业", major_ok(F.col("major"), profile.get("majors")))]
    return F.array_compact(F.array(*[F.when(~ok, name) for name, ok in tests]))


def escape_like(word):
    return word.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def keyword_rows(df, query, columns, region=None):
    """Every word must occur in at least one of the columns; letters match without regard to case."""
    for w in (query or "").split():
        df = df.where(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{escape_like(w)}%") for c in columns]))
    return df.where(F.col("region").ilike(f"%{escape_like(region)}%")) if region else df


def with_applicants(positions, applicants):
    return positions.join(applicants, "code", "left").withColumn("ratio", F.when(
        (F.col("applicants") > 0) & (F.col("count") > 0), F.bround(F.col("applicants") / F.col("count"), 1)))


def page_of(rated, sort, page, size=50):
    order = {"count": [F.desc("count")], "ratio": [F.asc_nulls_last("ratio")],
             "ratio_desc": [F.desc(F.coalesce("ratio", F.lit(0.0)))]}.get(sort, [])
    return rated.orderBy(*order, "code").offset((page - 1) * size).limit(size)


def import_applicants(positions, updates):
    """``updates(code, seq, applicants)``: the last value of a code wins. One row: codes matched and codes given."""
    last = updates.groupBy("code").agg(F.max_by("applicants", "seq").alias("applicants"))
    hit = last.join(positions.select("code", F.lit(1).alias("hit")).distinct(), "code", "left")
    return hit.agg(F.count("hit").alias("matched"), F.count("*").alias("rows"))
