"""Where founders worked before: one row per deal and employer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.functions.order import newest, oldest
from dealweave.functions.text import name_key, split_parts
from dealweave.operators.joins import alias_map, canonical_name, nearest_match, with_exists, with_in_flag
from dealweave.operators.lists import distinct_array, ordered_join
from dealweave.operators.rows import first_per_group
from dealweave.plans.model import Model
from dealweave.session import materialised

# Names of the evidence sources, and entity statuses that are not shown as employers.
VIA_PROFILE, VIA_FOUNDER_FIELD, VIA_DEAL_FIELD = "linkedin", "founder_field", "deal_field"
#: What the founder key of a deal's own fields starts with.
DEAL_PREFIX = "deal:"
#: Columns of the pipeline that the facts read.
FACT_SOURCES = ("id", "deal", "status", "meeting_date", "f3_classification", "sectors", "created_time", "founder_name",
                "founder_linkedin", "previous_company_worked_at", "previous_company")
UNRESOLVED = "unresolved"
UNCHECKED = "unchecked"


def deal_map(model_deals: DataFrame, pipeline: DataFrame) -> DataFrame:
    """(model_id, pipeline_id): each model deal's pipeline deal of the same name with the nearest meeting date."""
    left = model_deals.select(F.col("id").alias("model_id"), name_key("name").alias("key"), "meeting_date")
    right = pipeline.select(
        F.col("id").alias("pipeline_id"), name_key("deal").alias("key"), "meeting_date", "created_time")
    matched = nearest_match(
        left, right, "key", "meeting_date", "meeting_date", [newest("created_time"), oldest("pipeline_id")],
        ["pipeline_id"])
    return matched.select("model_id", F.col("match_pipeline_id").alias("pipeline_id")).filter(
        F.col("pipeline_id").isNotNull())


def employer_mentions(pipeline: DataFrame, model: Model, read: DataFrame | None = None) -> DataFrame:
    """Every employer named for a deal, from career entries (1), founder fields (2) and deal fields (3).

    ``read`` are the pipeline deals whose own fields are read, all without it. ``m`` holds the attributes of the model deal, as a list since an id may come more than once; NULL without one.
    Rows are dealt by deal before their lists are taken apart, so that a deal's texts and attributes travel once.
    """
    links = deal_map(model.deals, pipeline)
    m = model.deals.groupBy(F.col("id").alias("model_id")).agg(F.collect_list(F.struct(
        F.col("name").alias("deal"), "status", "meeting_date", "f3_classification", "sectors")).alias("m"))
    text = F.coalesce(
        F.nullif("previous_company_worked_at", F.lit("")), F.nullif("previous_company", F.lit("")))
    no_text = F.lit(None).cast("string")
    told = pipeline if read is None else read
    from_deals = told.select(
        F.col("id").alias("deal_id"), F.col("id").isNotNull().alias("in_pipeline"), no_text.alias("founder_key"),
        F.col("founder_name").alias("founder"), F.nullif("founder_linkedin", F.lit("")).alias("linkedin_url"),
        F.lit(None).cast(m.schema["m"].dataType).alias("m"),
        split_parts(text).alias("spellings"), no_text.alias("title"), F.lit(3).alias("priority"))
    people = (
        model.deal_founders.join(model.founders.withColumnRenamed("key", "founder_key"), "founder_key")
        .withColumnRenamed("deal_id", "model_id").join(links, "model_id", "left").join(m, "model_id", "left")
    )
    shared = [F.coalesce("pipeline_id", "model_id").alias("deal_id"), F.col("pipeline_id").isNotNull().alias("in_pipeline"),
              "founder_key", F.col("name").alias("founder"), "linkedin_url", "m"]
    from_founders = people.select(
        *shared, split_parts("previous_company_raw").alias("spellings"), no_text.alias("title"), F.lit(2).alias("priority"))
    # A founder's entries for one company differ only in the title: the best one is enough, and far fewer rows meet
    # the founder's deals.
    best_roles = first_per_group(
        model.roles.select("founder_key", "company", "title"), ["founder_key", "company"],
        [F.col("title").isNull(), oldest("title")])
    from_careers = people.join(best_roles, "founder_key").select(
        *shared, F.array("company").alias("spellings"), "title", F.lit(1).alias("priority"))
    dealt = from_deals.unionByName(from_founders).unionByName(from_careers).filter(F.size("spellings") > 0).repartition("deal_id")
    own = F.col("priority") == 3
    return dealt.withColumn("spelling", F.explode("spellings")).drop("spellings").withColumns({
        "founder_key": F.when(own, F.concat(F.lit(DEAL_PREFIX), "deal_id")).otherwise(F.col("founder_key")),
        "via": F.when(own, VIA_DEAL_FIELD).when(F.col("priority") == 2, VIA_FOUNDER_FIELD).otherwise(VIA_PROFILE)})


def _best_mentions(mentions: DataFrame, model: Model, entities: DataFrame, employer: Column) -> DataFrame:
    """The best mention per deal and employer, with the employer's entity label."""
    # The look-up tables are written: Spark then knows their sizes, and the mentions stay where they are if it broadcasts.
    names = materialised(alias_map(model.companies))
    labels = materialised(entities.select(
        F.col("name").alias("company"), "entity", "parent_group", F.col("status").alias("entity_status"),
        F.col("domain").alias("entity_domain"), "entity_type"))
    labelled = canonical_name(mentions, "spelling", names, "company").join(labels, "company", "left")
    # The mentions lie dealt by deal.
    return first_per_group(
        labelled.withColumn("_employer", employer), ["deal_id", "_employer"],
        [oldest("priority"), F.col("title").isNull(), oldest("founder_key"), oldest("spelling"), oldest("title")])


def _founder_deal_keys(founders: DataFrame) -> DataFrame:
    """Founder keys that look like those of deal fields; written, so that Spark knows how few they are."""
    return materialised(founders.filter(F.startswith("key", F.lit(DEAL_PREFIX))).select(F.col("key").alias("founder_key")))


def founder_facts(pipeline: DataFrame, model: Model, entities: DataFrame) -> DataFrame:
    """(founder_key, entity, entity_status): the rows of ``employer_facts`` that ``founder_career`` reads.

    A deal's own fields come after every founder's mention and have a key of their own. They decide nothing here unless a
    founder has that key, so the other deals' texts are neither taken apart nor dealt.
    """
    deals = pipeline.filter(F.col("deal").isNotNull())
    read = deals.join(_founder_deal_keys(model.founders), F.concat(F.lit(DEAL_PREFIX), "id") == F.col("founder_key"),
                      "left_semi")
    best = _best_mentions(employer_mentions(deals, model, read).drop("m", "founder", "linkedin_url"), model, entities,
                          F.lower(F.coalesce("entity", "company")))
    return best.select("founder_key", F.coalesce("entity", "company").alias("entity"),
                       F.coalesce("entity_status", F.lit(UNCHECKED)).alias("entity_status"))


def employer_facts(pipeline: DataFrame, model: Model, decided: DataFrame, entities: DataFrame,
                   dedupe: str = "entity") -> DataFrame:
    """Best mention per deal and employer, with the deal's attributes and the employer's entity label.

    ``dedupe="entity"`` tells employers apart by their entity and leaves ``in_raw_data`` NULL for deals outside the
    pipeline; ``dedupe="name"`` uses the text before the first comma and says false there.
    """
    deals = pipeline.filter(F.col("deal").isNotNull())
    if dedupe == "entity":
        employer = F.lower(F.coalesce("entity", "company"))
    else:
        employer = F.lower(F.trim(F.split_part("company", F.lit(","), F.lit(1))))
    best = _best_mentions(employer_mentions(deals, model), model, entities, employer)
    keys = decided.select("id")
    p = deals.select("id", F.struct("deal", "status", "meeting_date", "f3_classification", "sectors",
                                    "created_time").alias("p"))
    in_pipeline = F.col("in_pipeline")
    if dedupe == "entity":
        p = with_in_flag(p, keys, "id", "id", "_raw")
        outside = F.when(keys.agg(F.count(F.lit(1)).alias("n")).scalar() == 0, F.lit(False))
    else:
        p, outside = with_exists(p, keys, ["id"], "_raw"), F.lit(False)
    wide = best.join(p.withColumnRenamed("id", "_id"), (F.col("deal_id") == F.col("_id")) & in_pipeline, "left")
    wide = wide.withColumn("m", F.explode_outer("m"))
    for field in ("deal", "status", "meeting_date", "f3_classification", "sectors"):
        wide = wide.withColumn(field, F.coalesce(f"p.{field}", f"m.{field}"))
    wide = (
        wide.withColumn("has_linkedin", F.col("linkedin_url").isNotNull())
        .withColumn("source", F.when(in_pipeline, "pipeline").otherwise("snapshot"))
        .withColumn("created_date", F.col("p.created_time").cast("date"))
        .withColumn("in_raw_data", F.when(in_pipeline, F.col("_raw")).otherwise(outside))
    )
    wide = (
        wide.withColumn("parent_group", F.coalesce("parent_group", "entity", "company"))
        .withColumn("entity", F.coalesce("entity", "company"))
        .withColumn("entity_status", F.coalesce("entity_status", F.lit(UNCHECKED)))
    )
    return wide.select(
        "deal_id", "deal", "status", "meeting_date", "f3_classification", "sectors", "founder_key", "founder",
        "linkedin_url", "company", "title", "via", "has_linkedin", "source", "created_date", "in_raw_data", "entity",
        "parent_group", "entity_status", "entity_domain", "entity_type")


def founder_career(founders: DataFrame, roles: DataFrame, facts: DataFrame) -> DataFrame:
    """Per founder the known employers and the career as text."""
    known = facts.filter(F.col("entity_status") != UNRESOLVED).select("founder_key", "entity")
    # Facts from deal fields have keys of their own and are most of the rows: those that no founder has go before the
    # shuffle.
    deal_keys = _founder_deal_keys(founders)
    known = with_exists(known, deal_keys, ["founder_key"], "_held").filter(
        "_held or not " + f"startswith(founder_key, '{DEAL_PREFIX}')").select("founder_key", "entity").distinct()
    employers = known.groupBy("founder_key").agg(distinct_array("entity").alias("_companies"))
    entry = F.concat(
        F.coalesce(F.concat(F.nullif("title", F.lit("")), F.lit(" at ")), F.lit("")), F.coalesce("company", "raw"))
    told = roles.withColumn("_entry", entry).groupBy("founder_key").agg(
        ordered_join("_entry", ["raw"], "; ").alias("_told"))
    listed = F.concat(F.lit("Previously at: "), F.nullif(F.array_join("_companies", ", "), F.lit("")))
    return (
        founders.withColumnRenamed("key", "founder_key").join(employers, "founder_key", "left")
        .join(told, "founder_key", "left")
        .select("founder_key", "name", "linkedin_url",
                F.coalesce("_companies", F.array().cast("array<string>")).alias("companies"),
                F.coalesce("_told", listed).alias("career"))
    )


def employer_names(facts: DataFrame, statuses: tuple[str, ...] = ("verified", "probable", UNCHECKED)) -> DataFrame:
    """(key, employer): spelling in lower case to the entity, verified labels first."""
    named = facts.filter(F.col("entity").isNotNull() & F.col("entity_status").isin(*statuses)).select(
        F.lower(F.trim("company")).alias("key"), F.col("entity").alias("employer"), "entity_status")
    best = first_per_group(named, ["key"], [(F.col("entity_status") == "verified").desc(), oldest("employer")])
    return best.select("key", "employer")


def not_generic(column: str | Column) -> Column:
    """Leaves out entries that name no employer."""
    # Entries that mean "nobody's employee".
    generic = ("selfemployed", "Self", "Self-employed", "Freelance")
    return ~F.col(column).isin(*generic) if isinstance(column, str) else ~column.isin(*generic)
