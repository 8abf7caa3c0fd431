"""People, label pairs, messages and feeds derived from the given tables by plain arithmetic.

Every rule is an expression both Spark and DuckDB read, so that queries and their checks start from
the same rows. ``ABOUT`` texts name the table each one is made from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.config import (
    NHS_SYSTEM, Comparators, Lexicon, MatchingProfile, Secret, SourcePolicy, TenantConfig,
)
from kinweave.session import spread

TENANT = "demo"

# Names for the derived people.
FAMILIES = (
    "Smith,Smyth,García,O'Brien,Jackson,Jaxon,Thompson,Thomson,Phillips,Philips,Knight,Night,"
    "Schmidt,Müller,Miller,Johnson,Johnston,Clarke,Clark,Nguyen,Jones-Évans,Khan,Hughes,Carter,"
    "Wright,Right,MacDonald,McDonald,Edgeley,Aesop,Quill,Vaughn"
)
GIVENS = (
    "Alex,Alexa,Robert,Bob,Samira,Sameera,Alice,Alicia,Zoë,Zoe,José,Jose,Catherine,Katherine,Kate,"
    "William,Bill,Anne-Marie,Chloé,Mohammed,Muhammad,Priya,Olu,Wei,Siân,Sian,Renée,Elizabeth,Beth"
)
CITIES = "Leeds,York,Bath,Truro,Ely,Hull,Derby"
LETTERS = "A,B,D,E,F,G,H,J,L,N,P,Q,R,S,T,U,W,X,Y,Z"


def _pick(values: str, index: str) -> str:
    count = len(values.split(","))
    text = values.replace("'", "''")
    return f"split_part('{text}', ',', cast(1 + ({index}) % {count} as int))"


# Layers of expressions over ``customer``: each layer reads the columns of the one before.
_BASE = {
    "k": "c_custkey",
    "family": _pick(FAMILIES, "c_custkey * 7"),
    "given": _pick(GIVENS, "c_custkey * 5 + floor(c_custkey / 32)"),
    "dob": "date '1940-01-01' + cast((c_custkey * 7919) % 9000 as int)",
    "gender": "case when c_custkey % 7 = 0 then 'Unknown' when c_custkey % 2 = 0 then 'Female' "
              "else 'Male' end",
    "line": "concat(cast(c_custkey % 97 + 1 as string), ' High Street, Flat ', "
            "cast(c_custkey % 5 as string))",
    "city": _pick(CITIES, "c_custkey"),
    "postcode": "concat('LS', cast(c_custkey % 19 + 1 as string), ' ', "
                "cast(c_custkey % 9 + 1 as string), "
                + _pick(LETTERS, "c_custkey") + ", " + _pick(LETTERS, "floor(c_custkey / 20)")
                + ")",
    "phone": "concat('07700 ', lpad(cast(cast(floor(c_custkey / 3) as bigint) as string), 6, '0'))",
    "email": "case when c_custkey % 4 = 0 then concat(' User.', cast(c_custkey as string), "
             "'@Example.org ') end",
    "nhs9": "400000000 + (c_custkey * 4099) % 99999989",
    "trusted": "c_custkey % 2 = 0",
}
_NHS_SUM = " + ".join(
    f"cast(substring(cast(nhs9 as string), {i}, 1) as int) * {11 - i}" for i in range(1, 10)
)
_CHECKED = {
    "check_digit": f"(11 - ({_NHS_SUM}) % 11) % 11",
}
_NHS = {
    "nhs": "case when check_digit < 10 then "
           "concat(cast(nhs9 as string), cast(check_digit as string)) end",
}
_KEEP = ["k", "family", "given", "dob", "gender", "line", "city", "postcode", "phone", "email",
         "nhs", "trusted"]

# Seeded damage of the second source.
_DAMAGE = {
    "k": "k",
    "family": "case when k % 4 = 0 then concat(substring(family, 1, 1), substring(family, 3, 1), "
              "substring(family, 2, 1), substring(family, 4, 20)) else family end",
    "given": "case when k % 6 = 0 then substring(given, 1, 3) else given end",
    "dob": "case when k % 5 = 0 and extract(day from dob) <= 12 then make_date("
           "cast(extract(year from dob) as int), cast(extract(day from dob) as int), "
           "cast(extract(month from dob) as int)) when k % 33 = 0 then null else dob end",
    "gender": "gender",
    "line": "case when k % 9 = 0 then concat(cast(k % 11 + 200 as string), ' Station Road') "
            "else line end",
    "city": "city",
    "postcode": "case when k % 9 = 0 then concat('YO', cast(k % 7 + 1 as string), ' 9ZZ') "
                "else lower(postcode) end",
    "phone": "case when k % 6 = 3 then null else replace(phone, ' ', '-') end",
    "email": "email",
    "nhs": "nhs",
    "trusted": "trusted",
}


# The message of an event, over ``events``. chr(13) ends a segment.
_TRIGGER = ("case event_type when 'signup' then 'A28' when 'view' then 'A08' when 'click' then 'A31' "
            "when 'purchase' then 'A04' else 'A40' end")
_PERSON_FAMILY = "replace(" + _pick("Smith,Khan,Hughes@T@Co,García", "user_id") + ", '@', chr(92))"
_PERSON_GIVEN = _pick("Alex,Robert,Samira", "user_id")
ADT_TEXT = (
    "concat('MSH|^~', chr(92), '&|APP|FAC|MPI|X|20240101||ADT^', " + _TRIGGER
    + ", '|', cast(event_id as string), '|P|', case when event_id % 40 = 0 then '2.7' else '2.5.1' end, chr(13), "
    "'PID|1||U', cast(user_id as string), '^^^HOSP^MR||', " + _PERSON_FAMILY + ", '^', "
    + _PERSON_GIVEN + ", '||19', cast(50 + user_id % 50 as string), '0', cast(1 + user_id % 9 as string), "
    "case when event_id % 90 = 7 then '99' else '15' end, '|', "
    "case when user_id % 2 = 0 then 'F' else 'M' end, '|||1 High Street^^Leeds^^LS1 1AA||0113 496 ', "
    "lpad(cast(user_id % 10000 as string), 4, '0'), "
    "case when event_type = 'error' then concat(chr(13), 'MRG|U', cast(user_id + 1 as string), '^^^HOSP^MR') "
    "else '' end)"
)

# Contact patterns that Java and RE2 read alike.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9][0-9 ()-]{7,14}[0-9]"


def _select(layer: dict[str, str], extra: list[str] = ()) -> list[str]:
    return [f"{expr} AS {name}" for name, expr in layer.items()] + list(extra)


_A_LAYERS = [
    _select(_BASE),
    ["*"] + _select(_CHECKED),
    ["*"] + _select(_NHS),
    list(_KEEP) + ["'crm' AS source_system", "cast(k as string) AS local_id",
                   "'c' AS tag"],
]


def people_a_sql() -> str:
    """DuckDB text of the first source, over ``customer``."""
    inner = "customer"
    for layer in _A_LAYERS:
        inner = f"(SELECT {', '.join(layer)} FROM {inner})"
    return f"SELECT * FROM {inner}"


def people_b_sql() -> str:
    columns = _select(_DAMAGE, ["'billing' AS source_system",
                                "concat('B', cast(k as string)) AS local_id", "'b' AS tag"])
    return f"SELECT {', '.join(columns)} FROM ({people_a_sql()}) WHERE k % 3 = 0"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people_a_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spread(_table(spark, sf_dir, "customer").select("c_custkey"))
    for layer in _A_LAYERS:
        df = df.selectExpr(*layer)
    return df


def people_b_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = people_a_flat(spark, sf_dir).where("k % 3 = 0")
    return df.selectExpr(
        *_select(_DAMAGE, ["'billing' AS source_system",
                           "concat('B', cast(k as string)) AS local_id", "'b' AS tag"])
    )


def with_profile(flat: DataFrame) -> DataFrame:
    """Nest the flat columns into a profile."""
    def text(value):
        return F.lit(value).cast("string")

    identifiers = F.filter(
        F.array(
            F.struct(
                F.lit(NHS_SYSTEM).alias("system"), F.col("nhs").alias("value"),
                F.lit(False).alias("is_verified"), F.lit(False).alias("is_authoritative"),
                text("official").alias("use"),
            )
        ),
        lambda x: x["value"].isNotNull(),
    )
    telecoms = F.filter(
        F.array(
            F.struct(text("Phone").alias("system"), F.col("phone").alias("value"),
                     text(None).alias("use")),
            F.struct(text("Email").alias("system"), F.col("email").alias("value"),
                     text(None).alias("use")),
        ),
        lambda x: x["value"].isNotNull(),
    )
    tag = F.struct(text(None).alias("system"), text("x").alias("code"), text(None).alias("display"))
    tags = F.when(
        F.col("trusted"),
        F.array(tag.withField("code", F.lit("Traced")), tag.withField("code", F.lit("gold"))),
    ).otherwise(F.array().cast("array<struct<system:string,code:string,display:string>>"))
    profile = F.struct(
        identifiers.alias("identifiers"),
        F.array(
            F.struct(
                F.col("family"), F.array("given").alias("given"), text("Official").alias("use"),
                text(None).alias("prefix"), text(None).alias("suffix"),
            )
        ).alias("names"),
        F.col("dob").alias("birth_date"),
        F.col("gender"),
        F.array(
            F.struct(
                F.array("line").alias("lines"), F.col("city"), text(None).alias("district"),
                F.col("postcode").alias("postal_code"), text("GB").alias("country"),
                text("Home").alias("use"),
            )
        ).alias("addresses"),
        telecoms.alias("telecoms"),
        F.lit(False).alias("is_deceased"),
        tags.alias("tags"),
    )
    return flat.select(
        F.lit(TENANT).alias("tenant_id"), "source_system", "local_id", "k", profile.alias("profile")
    )


def demo_config(**changes) -> TenantConfig:
    """Two sources, one secret per version; the first source is authoritative."""
    lexicon = Lexicon.of(
        "en-gb-demo", "en-GB",
        {"ROBERT": "robert", "BOB": "robert", "WILLIAM": "william", "BILL": "william",
         "ELIZABETH": "elizabeth", "BETH": "elizabeth"},
    )
    profile = MatchingProfile(
        comparators=Comparators(
            given=("JaroWinkler", "Nickname"), lexicons=(lexicon,),
        )
    )
    base = dict(
        tenant_id=TENANT,
        secrets=(Secret("v1", bytes([1]) * 32, True),),
        profile=profile,
        sources=(("crm", SourcePolicy(100, True)), ("billing", SourcePolicy(50, False))),
    )
    return TenantConfig(**{**base, **changes}).check()
