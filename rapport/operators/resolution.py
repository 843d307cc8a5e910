"""Who is who: matching identities, senders and names, duplicates and merges.

Reference order ("first match in the people list") is replaced by a rule that
does not depend on row order: the candidate with the smallest
(created_at, person_id) wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rapport import constants as K
from rapport.functions.text import (clean_text, deterministic_id, duplicate_key, is_placeholder_label,
                                    is_user_label, norm_email, norm_name, norm_phone)
from rapport.operators.ledger import event_counts
from rapport.operators.ranking import first_per_group, top_per_group
from rapport.session import at_most, cut_lineage

#: Merges of up to this many people go to the rows that name them: some fifty megabytes.
BROADCAST_MERGES = 400_000
#: Lists of up to this many people are re-pointed where they lie, by one lookup a place.
PLACES = 8


def _earliest(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys -> person_id of the earliest candidate (map-side combined)."""
    return df.groupBy(*keys).agg(
        F.min_by("person_id", F.struct("created_at", "person_id")).alias("person_id"))


def _created(people: DataFrame) -> DataFrame:
    return people if "created_at" in people.columns else \
        people.withColumn("created_at", F.lit(None).cast("timestamp_ntz"))


def person_names(people: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(person_id, created_at, name) for display names and aliases, as written.
    ``aliases`` adds (person_id, alias) rows gained by merges and imports."""
    people = _created(people)
    names = F.concat(F.array("display_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = people.select("person_id", "created_at", F.explode(names).alias("name"))
    if aliases is not None:
        rows = rows.unionByName(aliases.join(people.select("person_id", "created_at"), "person_id")
                                .select("person_id", "created_at", F.col("alias").alias("name")))
    return rows.where(F.col("name").isNotNull() & (F.col("name") != ""))


def name_index(people: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(norm, person_id): whose normalised name or alias this is."""
    rows = person_names(people, aliases).withColumn("norm", norm_name(F.col("name"))).where(F.col("norm") != "")
    return _earliest(rows, ["norm"])


def identity_index(people: DataFrame, identities: DataFrame, kind: str) -> DataFrame:
    """(value, person_id) for one identity kind."""
    rows = (identities.where((F.col("kind") == kind) & (F.coalesce("value", F.lit("")) != ""))
            .join(_created(people).select("person_id", "created_at"), "person_id"))
    return _earliest(rows, ["value"])


def phone_matches(numbers: DataFrame, people: DataFrame, identities: DataFrame) -> DataFrame:
    """(digits, person_id): a stored number ends with the asked one or the other
    way round.

    Either way the shorter number equals a suffix of the longer, so each side's
    suffixes (a phone number has few) meet the other side's whole numbers on an
    equi-key. Exact for every length, no pair is formed that does not match.
    """
    asked = numbers.select(norm_phone(F.col("phone")).alias("digits")).where("digits != ''").distinct()
    stored = (identities.where((F.col("kind") == "phone") & (F.coalesce("value", F.lit("")) != ""))
              .join(_created(people).select("person_id", "created_at"), "person_id")
              .select("person_id", "created_at", "value").distinct())

    def suffixes(c: Column) -> Column:
        return F.explode(F.transform(F.sequence(F.lit(1), F.length(c)),
                                     lambda n: F.substring(c, -n, n)))

    stored_ends = stored.select("person_id", "created_at", suffixes(F.col("value")).alias("digits"))
    asked_ends = asked.select("digits", suffixes(F.col("digits")).alias("value"))
    first = asked.join(stored_ends, "digits").select("digits", "created_at", "person_id")
    second = asked_ends.join(stored, "value").select("digits", "created_at", "person_id")
    return _earliest(first.unionByName(second), ["digits"])


# -- names inside text ---------------------------------------------------------------

_WORDS = r"[\p{L}\p{N}_]+"
GRAM = 3


def name_mentions(texts: DataFrame, people: DataFrame) -> DataFrame:
    """(low, person_id, created_at, name_length): people whose name or alias stands in the
    lower-case text on word boundaries.

    Text and names meet on their first one to three words as an equi-key, then a
    boundary test on the whole name decides. Names shared by several people are
    reduced to one person before the join, so a common name does not multiply, and
    texts that repeat are read once. The joins are merge joins: names and texts both grow with
    the archive, and files of repeated or encoded values look small enough to broadcast.
    """
    names = person_names(people).withColumn("name", F.lower("name"))
    unique = names.groupBy("name").agg(
        F.min_by("person_id", F.struct("created_at", "person_id")).alias("person_id"), F.min("created_at").alias("created_at"))
    name_words = F.regexp_extract_all("name", F.lit(_WORDS), F.lit(0))
    keyed = (unique.withColumn("_w", name_words).where(F.size("_w") > 0)
             .select("name", "person_id", "created_at",
                     F.array_join(F.slice("_w", 1, GRAM), " ").alias("gram")))
    text_words = F.regexp_extract_all(F.lower("question"), F.lit(_WORDS), F.lit(0))

    def grams(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w))
        return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(GRAM), F.size(w) - i + 1)),
            lambda n: F.array_join(F.slice(w, i, n), " ")))))

    asked = (texts.select(F.lower("question").alias("question")).distinct()
             .select(F.col("question").alias("low"), text_words.alias("_w"))
             .where(F.size("_w") > 0)
             .select("low", F.explode_outer(grams(F.col("_w"))).alias("gram")).where("gram IS NOT NULL"))
    pairs = asked.join(keyed.hint("merge"), "gram")
    bounded = F.regexp_like("low", F.concat(F.lit(r"(?U)\b\Q"), F.col("name"), F.lit(r"\E\b")))
    return (pairs.where(F.contains("low", F.col("name")) & bounded)
            .select("low", "person_id", "created_at", F.length("name").alias("name_length")))


def person_in_question(texts: DataFrame, people: DataFrame) -> DataFrame:
    """(qid, person_id): the longest name mentioned; earliest person on a tie."""
    best = (-F.col("name_length")).alias("l"), F.col("created_at")
    found = name_mentions(texts, people).groupBy("low").agg(F.min(F.struct(*best, "person_id")).alias("best"))
    asked = texts.select("qid", F.lower("question").alias("low")).join(found.hint("merge"), "low")
    return asked.groupBy("qid").agg(F.min("best")["person_id"].alias("person_id"))


def voice_mention_suggestions(recordings: DataFrame, people: DataFrame) -> DataFrame:
    """Suggestions for recordings whose transcript names somebody."""
    texts = recordings.select(F.col("id").alias("qid"), F.col("transcript").alias("question"))
    found = person_in_question(texts, people).withColumnRenamed("qid", "id")
    rows = recordings.select("id", "filename").join(found.hint("merge"), "id")
    return rows.select(
        F.concat(F.lit("sug-voice-"), "id", F.lit("-"), "person_id").alias("id"),
        F.col("person_id").alias("person_a_id"), F.lit(None).cast("string").alias("person_b_id"),
        F.col("filename").alias("label"), F.lit("voice").alias("source"),
        F.lit(K.CONFIDENCE_VOICE_MENTION).alias("confidence"),
        F.lit("name mentioned in transcript").alias("reason"), F.lit("pending").alias("status"))


# -- senders ---------------------------------------------------------------------------

def resolve_senders(labels: DataFrame, people: DataFrame, identities: DataFrame,
                    user_labels=K.USER_LABELS, aliases: DataFrame | None = None) -> DataFrame:
    """Resolve distinct sender labels.

    ``labels``: label and, optionally, email / phone / username seen with it.
    Returns label, person_id (NULL for the owner and for placeholders), how
    ('owner', 'placeholder', 'name', 'email', 'phone', 'username', 'first_name',
    'new') and suggested_id, the earliest person an ambiguous first name could be.
    """
    for extra in ("email", "phone", "username"):
        if extra not in labels.columns:
            labels = labels.withColumn(extra, F.lit(None).cast("string"))
    clean = clean_text(F.col("label"))
    rows = labels.groupBy("label").agg(*[F.max(c).alias(c) for c in ("email", "phone", "username")])
    rows = rows.select(
        "label", clean.alias("clean"), norm_name(clean).alias("norm"),
        F.nullif(norm_email(F.col("email")), F.lit("")).alias("email"),
        F.nullif(norm_phone(F.col("phone")), F.lit("")).alias("digits"),
        F.nullif(F.lower("username"), F.lit("")).alias("username"),
        F.when((clean == "") | is_user_label(clean, user_labels), "owner")
        .when(is_placeholder_label(clean), "placeholder").alias("special"))

    def attach(rows: DataFrame, index: DataFrame, key: str, key_in_index: str, name: str) -> DataFrame:
        side = index.select(F.col(key_in_index).alias(key), F.col("person_id").alias(name))
        return rows.join(side, key, "left")

    rows = attach(rows, name_index(people, aliases), "norm", "norm", "by_name")
    rows = attach(rows, identity_index(people, identities, "email"), "email", "value", "by_email")
    phones = phone_matches(rows.select(F.col("digits").alias("phone")).where("phone is not null"),
                           people, identities)
    rows = attach(rows, phones, "digits", "digits", "by_phone")
    rows = attach(rows, identity_index(people, identities, "username"), "username", "value", "by_username")
    firsts = (person_names(people, aliases).withColumn("norm", F.substring_index(norm_name(F.col("name")), " ", 1))
              .where(F.length("norm") >= 3)
              .groupBy("norm").agg(
                  F.min("person_id").alias("low"), F.max("person_id").alias("high"),
                  F.min_by("person_id", F.struct("created_at", "person_id")).alias("earliest")))
    rows = rows.join(firsts, "norm", "left")
    unique = F.when(F.col("low") == F.col("high"), F.col("low"))
    created = F.concat(F.lit("person-"), deterministic_id(
        F.lit("sender"), F.coalesce(F.nullif("norm", F.lit("")), F.col("clean"))))
    known = F.coalesce("by_name", "by_email", "by_phone", "by_username", unique)
    how = (F.when(F.col("special").isNotNull(), F.col("special"))
           .when(F.col("by_name").isNotNull(), "name").when(F.col("by_email").isNotNull(), "email")
           .when(F.col("by_phone").isNotNull(), "phone").when(F.col("by_username").isNotNull(), "username")
           .when(unique.isNotNull(), "first_name").otherwise("new"))
    return rows.select(
        "label", "clean", "norm",
        F.when(F.col("special").isNull(), F.coalesce(known, created)).alias("person_id"),
        how.alias("how"),
        F.when(F.col("special").isNull() & known.isNull() & (F.col("low") != F.col("high")),
               F.col("earliest")).alias("suggested_id"))


def new_people(resolved: DataFrame) -> DataFrame:
    """Person rows for labels nobody was known under."""
    rows = first_per_group(resolved.where(F.col("how") == "new").select("person_id", "clean", "norm"),
                           ["person_id"], ["clean"])
    return rows.select("person_id", F.col("clean").alias("display_name"),
                       F.array().cast("array<string>").alias("aliases"), F.lit(False).alias("is_user"))


def new_aliases(resolved: DataFrame, people: DataFrame) -> DataFrame:
    """(person_id, alias): labels that reached a person by something other than
    their name."""
    found = resolved.where(F.col("how").isin("email", "phone", "username", "first_name"))
    known = people.select("person_id", norm_name(F.col("display_name")).alias("own"), "aliases")
    return (found.join(known, "person_id")
            .where((F.col("norm") != F.col("own")) & (F.col("clean") != "")
                   & ~F.coalesce(F.array_contains("aliases", F.col("clean")), F.lit(False)))
            .select("person_id", F.col("clean").alias("alias")).distinct())


def name_match_suggestions(resolved: DataFrame, source: str = "import") -> DataFrame:
    """Suggestions for ambiguous first names; nothing is merged silently."""
    rows = resolved.where(F.col("suggested_id").isNotNull())
    return rows.select(
        F.concat(F.lit("sug-"), "suggested_id", F.lit("-"), F.replace("norm", F.lit(" "), F.lit("-"))).alias("id"),
        F.col("suggested_id").alias("person_a_id"), F.lit(None).cast("string").alias("person_b_id"),
        F.col("clean").alias("label"), F.lit(source).alias("source"),
        F.lit(K.CONFIDENCE_NAME_MATCH).alias("confidence"),
        F.lit("first name matches an existing person").alias("reason"), F.lit("pending").alias("status"))


def assign_people(messages: DataFrame, resolved: DataFrame) -> DataFrame:
    """Messages with their person: the sender, or in a conversation with exactly
    one other party that party (so the owner's messages count for them)."""
    known = messages.drop("person_id").join(
        resolved.select(F.col("label").alias("sender_label"), "person_id", "how"), "sender_label", "left")
    parties = (known.where(F.col("person_id").isNotNull()).groupBy("conversation_id")
               .agg(F.min(F.struct("sender_label", "person_id")).alias("a"),
                    F.max(F.struct("sender_label", "person_id")).alias("b"))
               .where(F.col("a.sender_label") == F.col("b.sender_label"))
               .select("conversation_id", F.col("a.person_id").alias("only_person")))
    return (known.join(parties, "conversation_id", "left")
            .withColumn("one_to_one", F.col("only_person").isNotNull())
            .withColumn("person_id", F.coalesce("person_id", "only_person"))
            .drop("only_person"))


def conversation_participants(messages: DataFrame) -> DataFrame:
    """(conversation_id, person_id): who takes part, one row each."""
    return (messages.where(F.col("person_id").isNotNull())
            .select("conversation_id", "person_id").distinct())


# -- ledger emission -----------------------------------------------------------------------

def ledger_events(messages: DataFrame, emails: DataFrame, calendar: DataFrame, notes: DataFrame,
                  voice: DataFrame) -> DataFrame:
    """Interaction rows from every record kind.

    ``messages`` come from :func:`assign_people`; the owner's messages in a group
    are not interactions. Ids derive from person, kind, record and time, so the
    attendees of one meeting get different ids and re-imports repeat them.
    """
    def shape(df: DataFrame, kind: str, source: Column, at: str, summary: Column) -> DataFrame:
        return df.where(F.col("person_id").isNotNull() & F.col(at).isNotNull()).select(
            "person_id", F.lit(kind).alias("kind"), source.alias("source"),
            F.col(at).alias("occurred_at"), F.substring(summary, 1, 200).alias("summary"),
            F.col("id").alias("record_id"))

    counted = messages.where((F.coalesce("how", F.lit("")) != "owner") | F.col("one_to_one"))
    parts = [
        shape(counted, "message", F.col("source"), "sent_at",
              F.concat("sender_label", F.lit(": "), F.substring("content", 1, 80))),
        shape(emails, "email", F.lit("email"), "sent_at",
              F.coalesce(F.nullif("subject", F.lit("")), F.lit("(no subject)"))),
        shape(calendar.withColumn("person_id", F.explode("person_ids")), "meeting", F.lit("calendar"),
              "starts_at", F.col("title")),
        shape(notes, "note", F.lit("notes"), "noted_at", F.col("title")),
        shape(voice, "voice", F.lit("voice"), "recorded_at", F.col("filename")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    stamp = F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return rows.withColumn("id", F.concat(F.lit("evt-"), deterministic_id(
        F.col("person_id"), F.col("kind"), F.col("record_id"), stamp)))


# -- contacts --------------------------------------------------------------------------------

def resolve_contacts(contacts: DataFrame, people: DataFrame, identities: DataFrame) -> DataFrame:
    """Contacts with person_id and how they matched: email, then phone, then name,
    else a new person."""
    rows = (contacts.withColumn("_email", F.nullif(norm_email(F.col("email")), F.lit("")))
            .withColumn("_digits", F.nullif(norm_phone(F.col("phone")), F.lit("")))
            .withColumn("_norm", F.nullif(norm_name(F.col("name")), F.lit(""))))
    emails = identity_index(people, identities, "email").select(
        F.col("value").alias("_email"), F.col("person_id").alias("by_email"))
    phones = phone_matches(rows.where(F.col("_digits").isNotNull()), people, identities).select(
        F.col("digits").alias("_digits"), F.col("person_id").alias("by_phone"))
    names = name_index(people).select(F.col("norm").alias("_norm"), F.col("person_id").alias("by_name"))
    rows = rows.join(emails, "_email", "left").join(phones, "_digits", "left").join(names, "_norm", "left")
    created = F.concat(F.lit("person-"), deterministic_id(
        F.lit("contact"), F.coalesce("_email", "_digits", "_norm", "name")))
    how = (F.when(F.col("by_email").isNotNull(), "email").when(F.col("by_phone").isNotNull(), "phone")
           .when(F.col("by_name").isNotNull(), "name").otherwise("new"))
    return (rows.withColumn("person_id", F.coalesce("by_email", "by_phone", "by_name", created))
            .withColumn("how", how).drop("_email", "_digits", "_norm", "by_email", "by_phone", "by_name"))


def contact_people(resolved: DataFrame) -> DataFrame:
    """Person rows for contacts nobody matched."""
    display = F.coalesce(F.nullif("name", F.lit("")), F.nullif("email", F.lit("")),
                         F.nullif("phone", F.lit("")), F.lit("Unknown"))
    organisation = F.filter(F.array(F.nullif("organization", F.lit(""))), lambda o: o.isNotNull())
    rows = resolved.where(F.col("how") == "new").select(
        "person_id", display.alias("display_name"), organisation.alias("aliases"),
        F.lit(False).alias("is_user"))
    return first_per_group(rows, ["person_id"], ["display_name"])


def contact_identities(resolved: DataFrame) -> DataFrame:
    """(person_id, kind, value) every contact brings, handles in lower case under the kind they came with; distinct."""
    entries = F.array(
        F.struct(F.lit("name").alias("kind"), norm_name(F.col("name")).alias("value")),
        F.struct(F.lit("email").alias("kind"), norm_email(F.col("email")).alias("value")),
        F.struct(F.lit("phone").alias("kind"), norm_phone(F.col("phone")).alias("value")))
    if "usernames" in resolved.columns:
        handles = F.transform("usernames", lambda u: F.struct(u["kind"].alias("kind"), F.lower(u["value"]).alias("value")))
        entries = F.concat(entries, F.coalesce(handles, F.array().cast("array<struct<kind:string,value:string>>")))
    return resolved.select("person_id", F.inline(F.filter(entries, lambda e: e["value"] != ""))).distinct()


def contact_aliases(resolved: DataFrame, people: DataFrame, known: DataFrame) -> DataFrame:
    """(person_id, alias) that contacts add: nicknames, and names other than the one the person goes by. ``known`` are
    aliases of earlier imports; a name that differs in case or punctuation only is none."""
    none = F.array().cast("array<string>")
    nicknames = F.coalesce("aliases", none) if "aliases" in resolved.columns else none
    names = resolved.select("person_id", F.explode(F.concat(F.array("name"), nicknames)).alias("_name"))
    own = people.select("person_id", norm_name(F.col("display_name")).alias("_own"), F.coalesce("aliases", none).alias("_had"))
    rows = names.select("person_id", clean_text(F.col("_name")).alias("alias")).where("alias <> ''").join(own, "person_id")
    return (rows.where((norm_name(F.col("alias")) != F.col("_own")) & ~F.array_contains("_had", F.col("alias")))
            .select("person_id", "alias").distinct().join(known, ["person_id", "alias"], "left_anti"))


# -- duplicates, suggestions ------------------------------------------------------------------

def duplicate_people(people: DataFrame, events: DataFrame) -> DataFrame:
    """(key, keeper_id, person_id): people whose names differ in punctuation, case
    or encoding only; the keeper has the most interactions (smallest id on a tie).
    One row per duplicate: a group is never gathered in one place."""
    rows = (people.where(~F.coalesce("is_user", F.lit(False)))
            .select("person_id", duplicate_key(F.col("display_name")).alias("key")).where(F.col("key") != ""))
    ranked = rows.join(event_counts(events), "person_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    keepers = (ranked.groupBy("key")
               .agg(F.min_by("person_id", F.struct((-F.col("n")).alias("k"), "person_id")).alias("keeper_id"),
                    F.count("*").alias("members"))
               .where(F.col("members") > 1).select("key", "keeper_id"))
    return ranked.join(keepers, "key").where(F.col("person_id") != F.col("keeper_id")).select(
        "key", "keeper_id", "person_id")


def duplicate_suggestions(duplicates: DataFrame, people: DataFrame) -> DataFrame:
    rows = duplicates.join(people.select("person_id", "display_name"), "person_id")
    return rows.select(
        F.concat(F.lit("dup-"), "keeper_id", F.lit("-"), "person_id").alias("id"),
        F.col("keeper_id").alias("person_a_id"), F.col("person_id").alias("person_b_id"),
        F.col("display_name").alias("label"), F.lit("import").alias("source"),
        F.lit(K.CONFIDENCE_DUPLICATE).alias("confidence"),
        F.lit("same name from different threads").alias("reason"), F.lit("pending").alias("status"))


def decide_suggestions(suggestions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Suggestions with user decisions (id, merge) applied: accepted or rejected."""
    status = F.when(F.col("merge"), "accepted").when(~F.col("merge"), "rejected").otherwise(F.col("status"))
    return (suggestions.join(decisions.select("id", "merge"), "id", "left")
            .withColumn("status", status).drop("merge"))


def accepted_merges(suggestions: DataFrame) -> DataFrame:
    """(old_id, new_id) of accepted duplicate suggestions."""
    return suggestions.where((F.col("status") == "accepted") & F.col("person_b_id").isNotNull()).select(
        F.col("person_b_id").alias("old_id"), F.col("person_a_id").alias("new_id"))


def accepted_aliases(suggestions: DataFrame) -> DataFrame:
    """(person_id, alias) of accepted name suggestions."""
    return suggestions.where((F.col("status") == "accepted") & F.col("person_b_id").isNull()).select(
        F.col("person_a_id").alias("person_id"), F.col("label").alias("alias"))


def suggestion_evidence(suggestions: DataFrame, people: DataFrame, stored: DataFrame,
                        messages: DataFrame, limit: int = 4) -> DataFrame:
    """Both sides of a suggestion with their history, and a few messages of the
    conflicting side (one row per sample; samples are the newest)."""
    side = people.join(stored.select("person_id", "interaction_count", "last_interaction_at"),
                       "person_id", "left").select(
        "person_id", "display_name", F.coalesce("interaction_count", F.lit(0)).alias("n"),
        F.col("last_interaction_at").alias("last"))
    rename = lambda p: side.select(F.col("person_id").alias(f"person_{p}_id"),
                                   F.col("display_name").alias(f"name_{p}"),
                                   F.col("n").alias(f"interactions_{p}"), F.col("last").alias(f"last_{p}"))
    pairs = suggestions.join(rename("a"), "person_a_id", "left").join(rename("b"), "person_b_id", "left")
    by_person = messages.where(F.col("content") != "").select(
        F.col("person_id").alias("key"), F.col("id").alias("message_id"), "content", "sent_at")
    by_label = messages.where(F.col("content") != "").select(
        F.lower("sender_label").alias("key"), F.col("id").alias("message_id"), "content", "sent_at")
    order = [F.col("sent_at").desc_nulls_last(), F.asc("message_id")]
    newest = lambda df: top_per_group(df, ["key"], order, limit, "sample")
    duplicates = pairs.where(F.col("person_b_id").isNotNull()).withColumn("key", F.col("person_b_id"))
    labels = pairs.where(F.col("person_b_id").isNull()).withColumn("key", F.lower("label"))
    out = duplicates.join(newest(by_person), "key", "left").unionByName(
        labels.join(newest(by_label), "key", "left"))
    return (out.withColumn("sample_text", F.substring("content", 1, 220))
            .withColumn("suggestion_kind", F.when(F.col("person_b_id").isNull(), "name_match")
                        .otherwise("duplicate"))
            .drop("key", "content"))


# -- merging ---------------------------------------------------------------------------------

def resolve_merges(merge_map: DataFrame) -> DataFrame:
    """(old_id, new_id) with chains followed to their end and several targets of one
    person brought together: everybody whom merges connect becomes one person.

    The keeper is the smallest id that nobody merged away; in a pure cycle, the
    smallest of its targets. Smallest ids pass along the links, and every round also
    takes the label of the label, so a chain of length n closes in about log2(n) rounds.
    """
    edges = cut_lineage(merge_map.where(F.col("old_id") != F.col("new_id")).select("old_id", "new_id").distinct())
    links = cut_lineage(edges.select(F.col("old_id").alias("a"), F.col("new_id").alias("b"))
                        .unionByName(edges.select(F.col("new_id").alias("a"), F.col("old_id").alias("b"))))
    current = links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label")).select(
        "id", F.least("id", "label").alias("label"))
    current = cut_lineage(current)
    while True:
        near = (links.join(current.select(F.col("id").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near")))
        moved = cut_lineage(current.join(near, "id").select("id", F.col("label").alias("was"),
                                                            F.least("label", "near").alias("label")))
        ahead = current.select(F.col("id").alias("label"), F.col("label").alias("next"))
        moved = cut_lineage(moved.join(ahead, "label").select("id", "was", F.least("label", "next").alias("label")))
        done = moved.where("was != label").isEmpty()
        current = moved.select("id", "label")
        if done:
            break
    olds, targets = edges.select(F.col("old_id").alias("id")).distinct(), edges.select(F.col("new_id").alias("id")).distinct()
    marked = (current.join(olds.withColumn("old", F.lit(True)), "id", "left")
              .join(targets.withColumn("target", F.lit(True)), "id", "left"))
    keepers = marked.groupBy("label").agg(F.coalesce(
        F.min(F.when(F.col("old").isNull(), F.col("id"))), F.min(F.when(F.col("target"), F.col("id")))).alias("keeper"))
    return (marked.join(keepers, "label").where(F.col("id") != F.col("keeper"))
            .select(F.col("id").alias("old_id"), F.col("keeper").alias("new_id")))


def repoint(df: DataFrame, merges: DataFrame, column: str = "person_id") -> DataFrame:
    """Rows re-pointed from merged people to their keeper; ``moved`` marks them."""
    side = merges.select(F.col("old_id").alias(column), F.col("new_id").alias("_new"))
    return (df.join(side, column, "left").withColumn("moved", F.col("_new").isNotNull())
            .withColumn(column, F.coalesce("_new", column)).drop("_new").select(*df.columns, "moved"))


def repoint_array(df: DataFrame, merges: DataFrame, key: str, column: str) -> DataFrame:
    """The same for an array of person ids: members replaced one by one, distinct,
    co-attendees kept. Only rows that hold a merged id are rebuilt.

    Merges of people whom no row names stay behind. When those left are few enough (checked), they go to
    the rows, and lists of up to ``PLACES`` people are rebuilt without travelling; members of longer lists
    go on to their row by ``key`` if they change. More merges than that meet the members by a shuffle."""
    named = df.select(F.explode(column).alias("old_id"), F.size(column).alias("_size")).groupBy("old_id").agg(F.max("_size").alias("_size"))
    touched = cut_lineage(merges.select("old_id", "new_id").join(named, "old_id"))
    side = touched.drop("_size")
    if not at_most(side, BROADCAST_MERGES):
        return _repoint_members(df, side, key, column)
    side = F.broadcast(side)
    longest = touched.agg(F.coalesce(F.max("_size"), F.lit(1)))
    places = min(PLACES, longest.first()[0])
    # The longest list goes first: where it is short, no list is built for its size.
    long = F.coalesce((longest.scalar() > PLACES) & (F.size(column) > PLACES), F.lit(False))
    return _repoint_places(df.where(~long), side, column, places).unionByName(_repoint_members(df.where(long), side, key, column))


def _repoint_places(df: DataFrame, merges: DataFrame, column: str, places: int) -> DataFrame:
    """One lookup for each of the first ``places`` members."""
    out = df
    for i in range(places):
        side = merges.select(F.col("old_id").alias(f"_old{i}"), F.col("new_id").alias(f"_new{i}"))
        out = out.join(side, F.get(column, F.lit(i)) == F.col(f"_old{i}"), "left")
    found = [F.col(f"_new{i}") for i in range(places)]
    members = F.array(*[F.coalesce(n, F.get(column, F.lit(i))) for i, n in enumerate(found)])
    renamed = F.array_distinct(F.slice(members, 1, F.size(column)))
    return (out.withColumn("moved", F.coalesce(*found).isNotNull())
            .withColumn(column, F.when(F.col("moved"), renamed).otherwise(F.col(column))).select(*df.columns, "moved"))


def _repoint_members(df: DataFrame, merges: DataFrame, key: str, column: str) -> DataFrame:
    """Members travel once, to the merges; only those that change go on to their row, which
    is rebuilt in place."""
    members = df.select(key, F.posexplode(column).alias("_pos", "old_id"))
    changes = members.join(merges, "old_id").groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("_pos", "new_id"))).alias("_new"))
    renamed = F.array_distinct(F.transform(column, lambda m, i: F.coalesce(F.try_element_at("_new", i), m)))
    return (df.join(changes, key, "left").withColumn("moved", F.col("_new").isNotNull())
            .withColumn(column, F.when(F.col("moved"), renamed).otherwise(F.col(column))).select(*df.columns, "moved"))


def remove_member(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.withColumn(column, F.array_remove(column, value))


def replace_member(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return df.withColumn(column, F.array_distinct(F.transform(
        column, lambda m: F.when(m == old, F.lit(new)).otherwise(m))))


def surviving_people(people: DataFrame, merges: DataFrame) -> DataFrame:
    """People after the merge: those folded into somebody else are gone."""
    return people.join(merges.select(F.col("old_id").alias("person_id")), "person_id", "left_anti")


def gained_aliases(people: DataFrame, merges: DataFrame) -> DataFrame:
    """(person_id, alias): names a keeper takes over, distinct and without its own.

    Kept as rows: how many people end in one keeper has no bound. The merge table
    itself records who was absorbed.
    """
    names = person_names(people)
    gained = (merges.join(names.withColumnRenamed("person_id", "old_id"), "old_id")
              .select(F.col("new_id").alias("person_id"), F.col("name").alias("alias")).distinct())
    own = names.select("person_id", F.col("name").alias("alias"))
    return gained.join(own, ["person_id", "alias"], "left_anti")


def merge_identities(identities: DataFrame, merges: DataFrame) -> DataFrame:
    return repoint(identities, merges).drop("moved").dropDuplicates(["person_id", "kind", "value"])


def repair_names(people: DataFrame) -> DataFrame:
    """Back-fill: mojibake repaired in names and aliases; ``changed`` marks rows
    whose stored value differs."""
    from rapport.functions.text import repair_mojibake

    name = repair_mojibake(F.col("display_name"), rounds=4)
    aliases = F.transform("aliases", lambda a: repair_mojibake(a, rounds=4))
    changed = ~(name.eqNullSafe(F.col("display_name")) & aliases.eqNullSafe(F.col("aliases")))
    return people.withColumns({"changed": changed, "display_name": name, "aliases": aliases})
