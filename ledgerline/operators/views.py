"""What is shown of the directory: labels, cards, contact rows, relations, option lists, top lists, the facility list and published summaries."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions.text import blank_to_null, fold, shard
from ledgerline.operators import directory as D

# Kinds of facilities with their labels.
TYPE_LABELS = {
    "hospital": "Hospital",
    "day_surgery": "Day surgery centre",
    "polyclinic": "Polyclinic",
    "medical_center": "Medical centre",
    "clinic": "Clinic",
    "diagnostic_center": "Diagnostic centre",
    "laboratory": "Laboratory",
    "pharmacy": "Pharmacy",
    "dental": "Dental centre",
    "optical": "Optical centre",
    "physiotherapy": "Physiotherapy & rehabilitation",
    "home_healthcare": "Home healthcare",
    "nursing": "Nursing & care",
    "mental_health": "Mental health & behavioural",
    "maternity": "Maternity & fertility",
    "aesthetic": "Aesthetic & skin centre",
    "alternative": "Traditional & complementary medicine",
    "wellness": "Wellness centre",
    "veterinary": "Veterinary",
    "education": "School & nursery",
    "fitness": "Fitness & sports",
    "occupational": "Occupational & corporate health",
    "medical_supplier": "Medical supplies & equipment",
    "center": "Centre",
    "other": "Other healthcare provider",
}
# Parts of specialties and the short word readers know them by.
GLOSSES = [("otolaryngology", "ENT"), ("ophthalmology", "Eye"), ("orthopedic", "Bone/Joint"), ("orthopaedic", "Bone/Joint")]
# Short forms of licence names.
LICENCE_SHORT = {"Full-time License": "FTL", "Part-time License": "PTL", "Registered Only": "REG", "Trainee License": "TRL"}


def _looked_up(values: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def type_label(c: Column) -> Column:
    """Label of a kind; an unknown kind is its own label, none is "other"."""
    key = F.nullif(c, F.lit(""))
    return F.coalesce(_looked_up(TYPE_LABELS, key), key, F.lit(TYPE_LABELS["other"]))


def specialty_label(c: Column) -> Column:
    """A specialty with the word readers know it by; one that has it already stays."""
    with_gloss = [F.when(F.lower(c).contains(part), F.when(c.contains(f" - {gloss}"), c).otherwise(F.concat(c, F.lit(f" - {gloss}")))) for part, gloss in GLOSSES]
    return F.coalesce(*with_gloss, c)


def licence_badge(c: Column) -> Column:
    """The short form of a licence name, or the name."""
    return F.coalesce(_looked_up(LICENCE_SHORT, c), c)


def coordinates(lat: Column, lng: Column, around: float = 0.004) -> Column:
    """[P31] lat, lng and the box around them; NULL unless they are a place: numbers in range and not both 0."""
    a, b = lat.try_cast("double"), lng.try_cast("double")
    good = a.between(-90, 90) & b.between(-180, 180) & ~((a == 0) & (b == 0)) & ~F.isnan(a) & ~F.isnan(b)
    return F.when(good, F.struct(a.alias("lat"), b.alias("lng"), (b - around).alias("west"), (a - around).alias("south"), (b + around).alias("east"), (a + around).alias("north")))


def place_text(*parts: Column) -> Column:
    """[U6] The distinct parts of a place that there are, in order."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*[F.nullif(p, F.lit("")) for p in parts]))), ", ")


def _dialled(c: Column) -> Column:
    return F.concat(F.lit("tel:"), F.regexp_replace(c, r"[^\d+]", ""))


def _rows(*rows: tuple[str, Column, Column]) -> Column:
    return F.filter(F.array(*[F.struct(F.lit(kind).alias("kind"), value.alias("value"), href.alias("href")) for kind, value, href in rows]), lambda x: x["value"].isNotNull())


def contact_channels(mobile: Column, office: Column, email: Column, linked_in: Column, extra: Column) -> Column:
    """[P41] Array of (kind, value, href) of a person's channels; extra is a JSON text, a broken one counts as empty.

    The second address is shown only where it is another one, whatever its case; a handle becomes an address.
    """
    more = lambda *keys: F.coalesce(*[blank_to_null(F.get_json_object(extra, f"$.{k}")) for k in keys])
    first = blank_to_null(email)
    second = more("secondary_email", "contact_details_work_email")
    second = F.when(F.lower(second) != F.lower(F.coalesce(first, F.lit(""))), second)
    phone, phone2, page, handle = blank_to_null(mobile), F.coalesce(blank_to_null(office), more("contact_details_office_number")), blank_to_null(linked_in), more("twitter", "contact_details_twitter")
    mail = lambda c: F.concat(F.lit("mailto:"), c)
    x = F.when(handle.rlike("(?i)^https?:"), handle).otherwise(F.concat(F.lit("https://x.com/"), F.url_encode(F.regexp_replace(handle, "^@", ""))))
    return _rows(("phone", phone, _dialled(phone)), ("phone2", phone2, _dialled(phone2)), ("email", first, mail(first)), ("email2", second, mail(second)), ("linkedin", page, page), ("twitter", handle, x))


def facility_contacts(phone: Column, email: Column, website: Column, address: Column) -> Column:
    """[P47] Array of (kind, value, href) of a facility's channels; a bare host becomes an address."""
    tel, mail, web, at = (blank_to_null(c) for c in (phone, email, website, address))
    url = F.when(web.rlike("(?i)^https?://"), web).otherwise(F.concat(F.lit("https://"), web))
    return _rows(("telephone", tel, _dialled(tel)), ("email", mail, F.concat(F.lit("mailto:"), mail)), ("website", web, url), ("address", at, F.lit(None).cast("string")))


def add_on_names(detailed: Column, plain: Column) -> Column:
    """[P46] Names of add-ons: of the detailed list (JSON objects or texts) if it has any, else of the plain JSON list; broken JSON is no list."""
    def names(c: Column) -> Column:
        items = F.from_json(c, "array<string>")
        name = F.transform(items, lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x))
        return F.filter(name, lambda x: x.isNotNull() & (x != ""))
    rich = names(detailed)
    return F.when(F.size(rich) > 0, rich).otherwise(F.coalesce(names(plain), F.array().cast("array<string>")))


def accreditation(name: Column, body: Column, issued: Column, until: Column) -> Column:
    """[P46] headline, body where it is not the headline, and the days it holds."""
    day = lambda c: F.when(F.length(c) >= 10, F.substring(c, 1, 10))
    n, b = F.nullif(name, F.lit("")), F.nullif(body, F.lit(""))
    return F.struct(F.coalesce(n, b, F.lit("Accreditation")).alias("headline"), F.when(n.isNotNull(), b).alias("body"), F.array_join(F.array_compact(F.array(day(issued), day(until))), " — ").alias("days"))


def count_shown(licensed: Column, linked: Column) -> Column:
    """[P50] The licensed people of a facility, where they are not counted all linked ones, else none."""
    return F.coalesce(licensed, linked, F.lit(0))


def person_cards(people: DataFrame) -> DataFrame:
    """[P39] id and what a card says: first facility with the number of others, three languages with the number of others, the mark."""
    more = lambda n: F.when(n > 0, F.concat(F.lit(" +"), n.cast("string"))).otherwise("")
    facilities, languages = F.size("linked_facilities"), F.size("languages")
    return people.select(
        "id", "name", "category", specialty_label(F.col("specialty")).alias("specialty"), "nationality",
        F.when(F.col("first_facility").isNotNull(), F.concat("first_facility", more(facilities - 1))).alias("facility"),
        F.when(languages > 0, F.concat(F.array_join(F.slice("languages", 1, 3), " · "), more(languages - 3))).alias("languages"),
        F.when(F.size("licence_types") > 0, "verified").when(F.col("has_contact"), "contactable").alias("mark"),
    )


def facility_cards(facilities: DataFrame, counts: DataFrame, top: DataFrame) -> DataFrame:
    """[P40, A8] Facilities with the label of their kind, the people shown, a contact address and the three most frequent specialties.

    facilities: facility_id, name, type, telephone, website; counts: as register.facility_counts(); top: as register.top_specialties().
    """
    three = top.groupBy("facility_id").agg(F.array_sort(F.collect_list(F.struct("rank", "specialty"))).alias("t")).select("facility_id", F.array_join(F.transform("t", lambda x: x["specialty"]), " · ").alias("specialties"))  # three a facility
    web = facility_contacts(F.col("telephone"), F.lit(None).cast("string"), F.col("website"), F.lit(None).cast("string"))
    joined = facilities.join(counts, "facility_id", "left").join(three, "facility_id", "left")
    return joined.select("facility_id", "name", type_label(F.col("type")).alias("type"), count_shown(F.col("licensed_count"), F.col("doctor_count")).alias("people"), "specialties", F.array_join(F.transform(web, lambda x: x["href"]), " ").alias("links"))


def relations(link: DataFrame, people: DataFrame, facilities: DataFrame, counts: DataFrame) -> DataFrame:
    """[P49, O23, J7, P28] One row for each person and present facility: badge, place in the person's list, roles there, kind and size of the facility.

    Primary ones stand first, then licensed, then others, equal ones as they came. A facility without a record stays, with NULLs, one without a name does not.
    people: doctor_id, specialty; facilities: facility_id, name, type.
    """
    f = facilities.select("facility_id", "name", "type").dropDuplicates(["facility_id"]).withColumn("known", F.lit(True))
    rank = F.when(F.col("is_primary"), 0).when(F.col("is_licensed"), 1).otherwise(2)
    badges = F.array_compact(F.array(F.when(F.col("is_primary"), "Primary registration"), F.when(F.col("is_licensed"), "Active licence here"), F.when(rank == 2, "Linked facility")))
    joined = link.where("is_current").join(f, "facility_id", "left").where("known IS NULL OR trim(name) <> ''").join(people, "doctor_id", "left").join(counts.select("facility_id", "licensed_count", "doctor_count"), "facility_id", "left")
    own = F.when(F.col("specialty").isNotNull(), F.array("specialty")).otherwise(F.array().cast("array<string>"))
    roles = F.transform(F.when(F.size("roles") > 0, F.col("roles")).otherwise(own), specialty_label)
    place = F.row_number().over(Window.partitionBy("doctor_id").orderBy("rank", "first_at", "facility_id"))
    return joined.withColumn("rank", rank).select(
        "doctor_id", "facility_id", "name", F.when(F.col("known"), type_label(F.col("type"))).alias("type"), F.array_join(badges, ", ").alias("badges"), place.alias("place"),
        F.array_join(roles, ", ").alias("roles"), F.when(F.col("known"), count_shown(F.col("licensed_count"), F.col("doctor_count"))).alias("people"),
    )


def licence_cards(doctors: DataFrame, placements: DataFrame, facilities: DataFrame) -> DataFrame:
    """[J8, F29, P8] Licences of active people at known facilities: title (what stands before the first dot, without the status), facility, number, status."""
    active = doctors.where("removedAt IS NULL").select(F.col("id").alias("doctorId")).distinct()
    named = facilities.select(F.col("id").alias("facilityId"), F.col("nameTrimmed").alias("facility")).dropDuplicates(["facilityId"])
    head = F.substring_index(F.coalesce("sourceText", F.lit("")), " · ", 1)
    title = blank_to_null(F.regexp_replace(head, r"(?i)\s+(Active|Inactive)(,[^·]*)?$", ""))
    some = placements.where("relationType = 'current_license'").distinct().join(active, "doctorId", "left_semi").join(named, "facilityId")
    return some.select(F.col("doctorId").alias("doctor_id"), title.alias("title"), "facility", F.nullif("licenseNumber", F.lit("")).alias("number"), F.nullif("statusLabel", F.lit("")).alias("status"), F.col("createdAt").alias("at"))


def rosters(placements: DataFrame) -> DataFrame:
    """[S6, A4] (facility_id, people, seen): people on each facility's roster and when it was last seen; removed people count too."""
    on = placements.where("sourceSection = 'facility_roster' AND facilityId IS NOT NULL")
    return on.groupBy(F.col("facilityId").alias("facility_id")).agg(F.count_distinct("doctorId").alias("people"), F.max("updatedAt").alias("seen"))


def profile_sections(people: DataFrame, profiles: DataFrame) -> DataFrame:
    """[P52] (id, section, state): shown with its entries where the profile is at hand, else announced by the flag, else absent.

    profiles: id, work, education (numbers of entries), a row only for loaded profiles.
    """
    joined = people.select("id", "has_experience", "has_education").join(profiles.withColumn("loaded", F.lit(True)), "id", "left")
    state = lambda n, flag: F.when(F.col("loaded") & (F.col(n) > 0), F.concat(F.col(n).cast("string"), F.lit(" entries"))).when(F.col("loaded").isNull() & F.col(flag), "available").otherwise("absent")
    sections = F.array(F.struct(F.lit("experience").alias("section"), state("work", "has_experience").alias("state")), F.struct(F.lit("education").alias("section"), state("education", "has_education").alias("state")))
    return joined.select("id", F.explode(sections).alias("x")).select("id", "x.section", "x.state")


def facility_list(people: DataFrame, facilities: DataFrame, query: D.DirectoryQuery) -> DataFrame:
    """[P26, P27, J16, A28, O6, O7] The facilities a query shows, in order.

    facilities: facility, type. In mode `facilities` the words are looked for in the facility's own name and kind, and people are counted if they are linked to such a facility;
    a facility no matching person is at stays, unless the query asks something about people. In the other modes, under any filter, facilities of matching people are shown, and
    all that have people otherwise. A chosen kind holds for the facility itself. matching is NULL where nobody matches. Most people first, then by name in the
    order of the root collation; name-asc and name-desc by that alone.
    """
    words = D.folded_query(query.q).split()
    own_text = F.concat_ws(" ", fold(F.col("facility")), fold(type_label(F.col("type"))))
    hit = reduce(lambda a, b: a & b, [own_text.contains(w) for w in words], F.lit(True))
    f = facilities.select("facility", "type").where("facility IS NOT NULL").dropDuplicates(["facility"]).withColumn("hit", hit)
    alone = query.mode == "facilities"
    about_people = bool(query.toggles) or any(k not in ("facility", "facility_type") for k in query.chosen)
    filtered = bool(words) or bool(query.chosen) or bool(query.toggles)
    staffed = people.select("id", F.explode("linked_facilities").alias("facility"))
    every = staffed.groupBy("facility").agg(F.count(F.lit(1)).alias("doctor_count"))
    if alone:
        some = D.matched(people, replace(query, q=""))
        at = some.select("id", F.explode("linked_facilities").alias("facility"))
        if words:  # people who are at a facility that matches count at all of theirs
            ids = at.join(f.where("hit").select("facility"), "facility", "left_semi").select("id").distinct()
            at = at.join(ids, "id", "left_semi")
    else:
        at = D.matched(people, query).select("id", F.explode("linked_facilities").alias("facility"))
    per = at.groupBy("facility").agg(F.count(F.lit(1)).alias("matching"))
    joined = f.join(every, "facility", "left").join(per, "facility", "left").withColumn("doctor_count", F.coalesce("doctor_count", F.lit(0)))
    if alone:
        keep = F.col("hit") if words else F.lit(True) if filtered else F.col("doctor_count") > 0
        keep = keep & F.col("matching").isNotNull() if about_people else keep
    else:
        keep = F.col("matching").isNotNull() if filtered else F.col("doctor_count") > 0
    kinds = query.chosen.get("facility_type")
    keep = keep & F.coalesce(F.col("type").isin(*kinds), F.lit(False)) if kinds else keep
    shown = joined.where(keep).select("facility", "type", "doctor_count", "matching")
    name = F.collate(F.col("facility"), "UNICODE")
    order = {"name-asc": [name.asc(), F.asc("facility")], "name-desc": [name.desc(), F.asc("facility")]}.get(query.sort, [F.coalesce("matching", "doctor_count").desc(), name.asc(), F.asc("facility")])
    return shown.orderBy(*order)


def filter_options(counts: DataFrame, facet: str, *, selected: tuple[str, ...] = (), search: str = "", first: int = 8) -> DataFrame:
    """[P44, O10] (label, shown, cnt, pinned, place): a facet's options as offered. counts: facet, label, cnt.

    Options without rows are left out unless selected. A search looks at the label as shown: options whose added word matches come first, then those with a word that begins so.
    Selected ones stand above the others and are all shown; of the others the first few.
    """
    shown = specialty_label(F.col("label")) if facet == "specialty" else type_label(F.col("label")) if facet == "facility_type" else F.col("label")
    o = counts.where(F.col("facet") == facet).select("label", "cnt", shown.alias("shown"))
    missing = o.sparkSession.createDataFrame([(x,) for x in selected], "label string").join(o, "label", "left_anti").withColumn("cnt", F.lit(0).cast("long"))
    o = o.where("cnt > 0").unionByName(missing.select("label", "cnt", shown.alias("shown")))
    q = D.folded_query(search)
    rank = F.lit(0)
    if q:
        text = fold(F.col("shown"))
        o = o.where(text.contains(q))
        added = fold(F.expr("substr(shown, length(label) + 1)"))
        rank = F.when((F.col("shown") != F.col("label")) & added.contains(q), -2).when(text.startswith(q) | text.contains(" " + q), -1).otherwise(0)
    o = o.withColumn("pinned", F.col("label").isin(*selected) if selected else F.lit(False)).withColumn("rank", rank)
    best = o.where("NOT pinned").orderBy("rank", F.desc("cnt"), F.collate(F.col("shown"), "UNICODE"), "label").limit(first).union(o.where("pinned"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("pinned"), "rank", F.desc("cnt"), F.collate(F.col("shown"), "UNICODE"), "label"))  # the few that are shown
    return best.withColumn("place", place).select("label", "shown", "cnt", "pinned", "place")


def ranked_top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """[O9, O11-O13, O26, W4] The first n rows with their place; only n rows are numbered together."""
    few = df.orderBy(*order).limit(n)
    return few.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def in_columns(top: DataFrame, columns: int, n: int) -> DataFrame:
    """[O13] ranked_top() laid out in columns, filled one after the other."""
    per = -(-n // columns)
    return top.withColumn("col", F.floor((F.col("place") - 1) / per).cast("int")).withColumn("row", ((F.col("place") - 1) % per).cast("int"))


def profile_index(profiles: DataFrame) -> DataFrame:
    """[K3, A14] One row: the rule that names a shard, shards in use, profiles, entries of work and education and people with any."""
    return profiles.agg(
        F.lit("last 3 characters of the id, filled with 0").alias("shard_rule"), F.count_distinct(shard(F.col("id"))).alias("shards"), F.count(F.lit(1)).alias("profiles"),
        F.sum("work").alias("work_entries"), F.sum("education").alias("education_entries"), F.count_if(F.col("work") > 0).alias("with_work"), F.count_if(F.col("education") > 0).alias("with_education"),
    )


def export_statistics(link: DataFrame, licences: DataFrame, people: DataFrame) -> DataFrame:
    """[A15] One row: pairs, most facilities of a person, people at several, people with several licences, repeated ids."""
    per = link.where("is_current").groupBy("doctor_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("pairs"), F.max("n").alias("most_facilities"), F.count_if(F.col("n") > 1).alias("at_several"))
    held = licences.agg(F.count_if(F.size("licence_types") > 1).alias("several_licences"))
    twice = people.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_ids"))
    one = lambda df: df.withColumn("_", F.lit(0))
    return one(per).join(one(held), "_").join(one(twice), "_").drop("_")  # three single rows


def doctor_route(c: Column) -> Column:
    """[F31]"""
    return F.concat(F.lit("/#/doctor/"), F.url_encode(c))


def facility_route(c: Column) -> Column:
    """[F31]"""
    return F.concat(F.lit("/#/facility/"), F.url_encode(c))


def specialty_route(c: Column) -> Column:
    """[J21] The directory's list of people of a specialty; a blank is %20 as in a browser's encoding."""
    return F.concat(F.lit("/?smode=professionals&spec="), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")))


def valid_slug(c: Column) -> Column:
    """[F33]"""
    return F.coalesce(c.rlike("^[a-z0-9-]{4,120}$"), F.lit(False))


def client_key(address: Column, agent: Column) -> Column:
    """Sixteen hex digits that stand for a client."""
    return F.substring(F.sha2(F.concat(F.coalesce(address, F.lit("")), F.lit("|"), F.coalesce(agent, F.lit(""))), 256), 1, 16)


def view_figure(live: Column, published: Column) -> Column:
    """[P51] The live counter, else the published figure, and only a positive one."""
    figure = F.coalesce(live, published)
    return F.when(figure > 0, figure)


def education_lines(e: Column) -> Column:
    """headline and secondary line of an education entry (institution, qualification, heading)."""
    i, q, h = (F.nullif(e[x], F.lit("")) for x in ("institution", "qualification", "heading"))
    other = F.array_compact(F.array(F.when(i.isNotNull(), q), F.when(h.isNotNull() & ~h.eqNullSafe(q) & (i.isNotNull() | q.isNotNull()), h)))
    return F.struct(F.coalesce(i, q, h, F.lit("Institution not published")).alias("headline"), F.array_join(other, " · ").alias("secondary"))

