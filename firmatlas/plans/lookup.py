"""Company profiles, and batch lookups by number, VAT number and name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmatlas.functions.identifiers import dotted_number, remove_blanks, strip_blanks, vat_digits
from firmatlas.operators.keyed import dealt, task_count
from firmatlas.operators.registry import NUMBER, code_labels, decode_companies, profile_names
from firmatlas.plans import name_index
from firmatlas.schemas import DEFAULT_COUNTRY

Tables = Mapping[str, DataFrame]
ADDRESS_TYPE = "struct<street:string,houseNumber:string,postalZone:string,city:string,country:string>"
CONTACT_TYPE = "struct<type:string,value:string>"


def profiles(tables: Tables, wanted: DataFrame | None = None) -> DataFrame:
    """Company with decoded codes, name, addresses and contacts.

    Children are grouped per company before the joins. Their keys bound a group: one address
    per address type, one contact per contact code and type, one name.
    ``wanted`` (company numbers) reduces every table first; Spark broadcasts the numbers or shuffles
    them, by their size, into tasks whose number grows with the input. Tables of companies are never broadcast.
    """
    enterprise = tables["Enterprise"]
    name, address, contact = (
        tables[t].withColumnRenamed("enterpriseId", NUMBER).filter(F.col(NUMBER).isNotNull())
        for t in ("Denomination", "KBOAddress", "KBOContact")
    )
    if wanted is not None:
        tasks = max(task_count(df) for df in (wanted, enterprise, name, address, contact))
        numbers = dealt(wanted.select(NUMBER).filter(F.col(NUMBER).isNotNull()).distinct(), NUMBER, tasks=tasks)
        enterprise, name, address, contact = (
            df.join(numbers, NUMBER, "left_semi") for df in (enterprise, name, address, contact)
        )
    names = profile_names(name.withColumnRenamed(NUMBER, "enterpriseId"))
    return (
        decode_companies(enterprise, tables["Code"])
        .join(names.hint("merge"), NUMBER, "left")
        .join(_addresses(address).hint("merge"), NUMBER, "left")
        .join(_contacts(contact, tables["Code"]).hint("merge"), NUMBER, "left")
        .select(
            NUMBER,
            F.coalesce("name", F.lit("")).alias("name"),
            F.coalesce("addresses", F.array().cast(f"array<{ADDRESS_TYPE}>")).alias("addresses"),
            F.coalesce("contacts", F.array().cast(f"array<{CONTACT_TYPE}>")).alias("contacts"),
            "juridicalForm",
            "juridicalSituation",
            "startDate",
            "status",
        )
    )


def _text(*columns: str, default: str = "") -> Column:
    return F.coalesce(*columns, F.lit(default))


def _addresses(address: DataFrame) -> DataFrame:
    entry = F.struct(
        F.col("typeOfAddressCode"),
        F.struct(
            _text("streetNL", "streetFR").alias("street"),
            _text("houseNumber").alias("houseNumber"),
            _text("zipcode").alias("postalZone"),
            _text("municipalityNL", "municipalityFR").alias("city"),
            _text("countryNL", "countryFR", default=DEFAULT_COUNTRY).alias("country"),
        ).alias("value"),
    )
    listed = F.array_sort(F.collect_list(entry))
    return address.groupBy(NUMBER).agg(F.transform(listed, lambda x: x["value"]).alias("addresses"))


def _contacts(contact: DataFrame, code: DataFrame) -> DataFrame:
    labelled = contact.join(
        code_labels(code, "ContactType", "conctactTypeCode", "label"), "conctactTypeCode", "left"
    )
    entry = F.struct(
        F.col("entityContactCode"),
        F.col("conctactTypeCode"),
        F.struct(_text("label").alias("type"), F.col("value")).alias("value"),
    )
    listed = F.array_sort(F.collect_list(entry))
    return labelled.groupBy(NUMBER).agg(F.transform(listed, lambda x: x["value"]).alias("contacts"))


def _with_profiles(asked: DataFrame, tables: Tables, wanted: DataFrame | None = None) -> DataFrame:
    """asked with the profiles of its companies (``wanted``, or those of asked)."""
    found = profiles(tables, asked if wanted is None else wanted)
    # Rows without a company find none; they are dealt by what they hold, not all to one task.
    plain = [f.name for f in asked.schema if "map<" not in f.dataType.simpleString()]
    key = F.coalesce(NUMBER, F.concat(F.lit("\0"), F.xxhash64(*plain).cast("string")))
    tasks = max(task_count(df) for df in (asked, found))
    joined = dealt(asked.withColumn("meets", key), "meets", tasks=tasks).join(
        found.withColumnRenamed(NUMBER, "meets").hint("merge"), "meets", "left"
    )
    return joined.select(NUMBER, *[c for c in asked.columns if c != NUMBER], *[c for c in found.columns if c != NUMBER])


def lookup_numbers(queries: DataFrame, tables: Tables, number: str = "number") -> DataFrame:
    """Every query row with its company profile, or nulls when the number is unknown."""
    return _with_profiles(queries.withColumn(NUMBER, dotted_number(remove_blanks(F.col(number)))), tables)


def lookup_vats(
    queries: DataFrame, tables: Tables, country: str = "country", vat: str = "vat"
) -> DataFrame:
    """Only Belgian VAT numbers are resolved; others keep a row of nulls."""
    digits = F.when(F.upper(country) == "BE", vat_digits(F.col(vat)))
    return _with_profiles(queries.withColumn(NUMBER, dotted_number(digits)), tables)


def asked_texts(names: DataFrame, name: str = "name") -> DataFrame:
    return (
        names.select(F.lower(strip_blanks(F.col(name))).alias("text"))
        .filter(F.length("text") > 0)
        .distinct()
    )


# Characters of a search text by which places in names are found before pieces are cut.
HEAD = 4
# Bytes of stored names for a task that takes them to pieces.
NAME_BYTES = 256 << 10


def resolve_names(asked: DataFrame, denomination: DataFrame) -> DataFrame:
    """Distinct search texts with the lowest company number that carries the name.

    A text equal to a name (ignoring case) wins; otherwise names that contain it count. The
    containing case is an equality join too. Only places in a name where the first characters
    of some asked text stand are kept, and at these only pieces as long as such texts are cut.
    No pair of a text and a name is ever built that does not match, and both steps keep only the
    lowest company per name or piece before they shuffle, so a name shared by very many companies
    does no harm. A name gives at most ``HEAD`` keys for each of its characters.
    """
    # One row per distinct name.
    known = (
        denomination.filter(F.col("enterpriseId").isNotNull() & F.col("denomination").isNotNull())
        .groupBy(F.lower("denomination").alias("text"))
        .agg(F.min("enterpriseId").alias(NUMBER))
    )
    tasks = task_count(known, NAME_BYTES)
    known = dealt(known, "text", tasks=tasks)
    size = F.length("text")
    # Each text asks for its head, and its own text at the places of that head.
    heads = asked.select(F.substring("text", 1, HEAD).alias("head"), size.alias("size")).distinct()
    heads = heads.groupBy("head").agg(F.collect_set("size").alias("sizes"))
    places = known.select("text", NUMBER, F.explode(F.sequence(F.lit(1), size)).alias("at")).filter(size > 0)
    # Shorter texts than a head are their own head.
    keys = F.array_distinct(F.array(*[F.substring(F.col("text"), F.col("at"), F.lit(n)) for n in range(1, HEAD + 1)]))
    # An outer join, whose left side Spark never broadcasts: it takes exploded places for as small as their names.
    places = places.select("text", NUMBER, "at", F.explode(keys).alias("head")).join(heads, "head", "left")
    pieces = places.select("text", NUMBER, "at", F.explode_outer("sizes").alias("size")).filter(
        F.col("size").isNotNull() & (F.col("at") + F.col("size") - 1 <= size)
    )
    pieces = pieces.select(F.substring(F.col("text"), F.col("at"), F.col("size")).alias("text"), NUMBER, (F.col("size") == size).alias("exact"))
    # The lowest company of a whole name goes before that of any piece.
    lowest = F.min_by(NUMBER, F.struct(~F.col("exact"), NUMBER)).alias(NUMBER)
    texts = dealt(asked, "text", tasks=tasks).hint("merge")
    found = dealt(pieces, "text", tasks=tasks).join(texts, "text", "left_semi").groupBy("text").agg(lowest)
    return asked.join(found.hint("merge"), "text", "left")


def lookup_names(queries: DataFrame, tables: Tables, name: str = "name", index: str | None = None) -> DataFrame:
    """Every query row with the profile of the company it names, or nulls.

    ``index`` is the folder of a stored index of the same names (``name_index``); without one all names
    are searched.
    """
    texts = asked_texts(queries, name)
    resolved = name_index.resolve(texts, index) if index else resolve_names(texts, tables["Denomination"])
    asked = queries.withColumn("text", F.lower(strip_blanks(F.col(name))))
    found = asked.join(resolved.hint("merge"), "text", "left").drop("text")
    return _with_profiles(found, tables, resolved)
