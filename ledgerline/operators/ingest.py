"""Taking a batch of feed items in, one after another: what is new, what repeats a stored item, what a repeat changes [T1, T2]."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.components import components

KEYS = ("canonical_url", "source_hash", "content_hash", "normalized_title", "story_key")
ITEM = "id string, source_id string, seq long, canonical_url string, source_hash string, content_hash string, normalized_title string, story_key string, at timestamp"
#: What an item holds besides, and what a changed repeat replaces: a missing picture keeps the old one.
PAYLOAD = "link string, title string, excerpt string, content_html string, author string, categories array<string>, image string"
STORED = f"{ITEM}, {PAYLOAD}, story_id string"
REPLACED = ("excerpt", "content_html", "image")
DECISION = "id string, decision string, duplicate_of string, reason string, story_id string, new_content_hash string"
_DAY = pd.Timedelta(days=1)


def replay(stored: list[dict], items: list[dict]) -> list[dict]:
    """Decides items in order of seq against stored rows and the items taken in before them.

    The first of five keys that hits decides, and of several rows the earliest taken in: address, source hash, content hash, title less than a day apart; a
    story of another source less than two days apart is kept but shares the stored row's story. A repeat is not stored, but where its content
    hash is new it replaces the stored row's, so that later items meet the new one and no longer the old.
    """
    rows = [dict(r, story=r.get("story_id") or r["id"]) for r in sorted(stored, key=lambda r: (r["seq"], r["id"]))]
    index: dict[tuple[str, str], list[int]] = {}
    for i, r in enumerate(rows):
        for k in KEYS:
            if r[k]:
                index.setdefault((k, r[k]), []).append(i)
    out = []
    for c in sorted(items, key=lambda r: (r["seq"], r["id"])):
        hit, reason = None, None
        for k in KEYS:
            for i in index.get((k, c[k]), ()) if c[k] else ():
                r = rows[i]
                if k in ("normalized_title", "story_key"):
                    if r["at"] is None or c["at"] is None or abs(r["at"] - c["at"]) >= _DAY * (1 if k == "normalized_title" else 2):
                        continue
                    if k == "story_key" and r["source_id"] == c["source_id"]:
                        continue
                hit, reason = i, k
                break
            if hit is not None:
                break
        if hit is None or reason == "story_key":
            story = rows[hit]["story"] if hit is not None else c["id"]
            out.append({"id": c["id"], "decision": "new", "duplicate_of": None, "reason": reason, "story_id": story, "new_content_hash": None})
            rows.append(dict(c, story=story))
            for k in KEYS:
                if c[k]:
                    index.setdefault((k, c[k]), []).append(len(rows) - 1)
            continue
        r, changed = rows[hit], None
        if c["content_hash"] and c["content_hash"] != r["content_hash"]:
            changed = c["content_hash"]
            if r["content_hash"]:
                index[("content_hash", r["content_hash"])].remove(hit)
            r["content_hash"] = changed
            places = index.setdefault(("content_hash", changed), [])
            places.append(hit)
            places.sort()
        out.append({"id": c["id"], "decision": "duplicate", "duplicate_of": r["id"], "reason": reason, "story_id": r["story"], "new_content_hash": changed})
    return out


def decide(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Decisions of replay() for a whole batch. stored may have story_id; other columns than those of ITEM are not read.

    Items and the stored rows that share a key with one are parted into components of shared keys, a title or story key counting with its time in
    buckets, neighbours included; each component is played through by itself. Items that share no key with anything skip that step.
    """
    names = [c.split()[0] for c in ITEM.split(", ")]
    new = items.select(*names).dropDuplicates(["id"])
    old = stored.select(*names, (F.col("story_id") if "story_id" in stored.columns else F.col("id")).alias("story_id"))

    def keyed(df: DataFrame) -> DataFrame:
        parts = [F.array(F.concat(F.lit(k + ":"), F.col(k))) for k in KEYS[:3]]
        for k, days in (("normalized_title", 1), ("story_key", 2)):  # rows less than a bucket apart share one of its two
            bucket = F.floor(F.unix_timestamp("at") / (86_400 * days))
            parts.append(F.array(*[F.concat(F.lit(k + ":"), F.col(k), F.lit(":"), (bucket + i).cast("string")) for i in (0, 1)]))
        return df.select("id", F.explode(F.array_compact(F.concat(*parts))).alias("key"))

    mine, theirs = keyed(new), keyed(old)
    met = theirs.join(mine.select("key").distinct(), "key", "left_semi")
    edges = mine.select(F.concat(F.lit("n:"), "id").alias("node"), "key").union(met.select(F.concat(F.lit("o:"), "id"), "key"))
    shared = edges.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    group = components(edges.join(shared, "key", "left_semi").withColumn("key", F.concat(F.lit("k:"), "key")), "node", "key").where("node LIKE 'n:%' OR node LIKE 'o:%'")
    a = new.withColumn("node", F.concat(F.lit("n:"), "id")).join(group, "node", "left")
    alone = a.where("component IS NULL").select("id", F.lit("new").alias("decision"), F.lit(None).cast("string").alias("duplicate_of"), F.lit(None).cast("string").alias("reason"), F.col("id").alias("story_id"), F.lit(None).cast("string").alias("new_content_hash"))
    together = a.where("component IS NOT NULL").select("component", F.lit(True).alias("fresh"), *names, F.lit(None).cast("string").alias("story_id"))
    b = old.withColumn("node", F.concat(F.lit("o:"), "id")).join(group, "node").select("component", F.lit(False).alias("fresh"), *names, "story_id")

    def play(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
        return pd.DataFrame(replay([r for r in rows if not r["fresh"]], [r for r in rows if r["fresh"]]), columns=[c.split()[0] for c in DECISION.split(", ")])

    return alone.union(together.union(b).groupBy("component").applyInPandas(play, DECISION))


def fresh(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """[K14] The new items of a batch as they are stored: what an item holds, its payload as far as given, and its story."""
    payload = [c.split()[0] for c in PAYLOAD.split(", ") if c.split()[0] in items.columns]
    return items.join(decisions.where("decision = 'new'").select("id", "story_id"), "id").select(*[c.split()[0] for c in ITEM.split(", ")], *payload, "story_id")


def changes(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """[T2] What the repeats of a batch change: id of the stored row, seq and by (the repeat), content_hash and the replaced columns that items have."""
    here = [c for c in REPLACED if c in items.columns]
    return decisions.where("new_content_hash IS NOT NULL").join(items.select("id", "seq", *here), "id").select(F.col("duplicate_of").alias("id"), "seq", F.col("id").alias("by"), F.col("new_content_hash").alias("content_hash"), *here)


def applied(stored: DataFrame, change: DataFrame) -> DataFrame:
    """[T2] Stored rows with changes(): the hash, excerpt and content of the last change, and the last picture there is. Title, summary key and the rest stay."""
    here = [c for c in REPLACED if c in change.columns and c in stored.columns]
    when = F.struct("seq", "by")
    last = [F.max_by(F.struct(F.col("content_hash").alias("h"), *[c for c in here if c != "image"]), when).alias("new")]
    last += [F.max_by("image", F.when(F.col("image").isNotNull(), when)).alias("new_image")] if "image" in here else []
    every = stored.join(change.groupBy("id").agg(*last), "id", "left")
    value = {"content_hash": F.coalesce("new.h", "content_hash")} | {c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)) for c in here if c != "image"}
    value |= {"image": F.coalesce("new_image", "image")} if "image" in here else {}
    return every.select(*[value.get(c, F.col(c)).alias(c) for c in stored.columns])


def merged(stored: DataFrame, items: DataFrame, decisions: DataFrame) -> DataFrame:
    """[K14, T2] The store after a batch: stored rows and new items, with what repeats changed.

    The payload columns that items or stored have are carried; one that only one side has is NULL on the other.
    """
    payload = [c.split()[0] for c in PAYLOAD.split(", ") if c.split()[0] in {*items.columns, *stored.columns}]
    names = [c.split()[0] for c in ITEM.split(", ")]
    every = stored.select(*names, *[c for c in payload if c in stored.columns], "story_id").unionByName(fresh(items, decisions), allowMissingColumns=True)
    return applied(every.select(*names, *payload, "story_id"), changes(items, decisions))


def run_summary(decisions: DataFrame, items: DataFrame) -> DataFrame:
    """[A31] Seen, new and repeated items of each source."""
    return items.select("id", "source_id").join(decisions, "id").groupBy("source_id").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("decision") == "new").alias("new"), F.count_if(F.col("decision") == "duplicate").alias("duplicate"), F.count_if(F.col("new_content_hash").isNotNull()).alias("updated"))
