"""Explicit schemas of the archive tables (DDL)."""

_ATTACHMENTS = "array<struct<kind:string,filename:string,filename_key:string,label:string>>"

_PROFILE = ("person_id string, status string, status_reason string, interaction_count bigint, "
            "interactions_14d bigint, interactions_60d bigint, last_interaction_at timestamp_ntz, "
            "source_breakdown map<string,bigint>, "
            "topics array<struct<topic:string,count:bigint,last_seen:timestamp_ntz>>, "
            "active_topics array<struct<topic:string,count:bigint>>, "
            "upcoming_events array<struct<id:string,title:string,starts_at:timestamp_ntz>>, updated_at timestamp_ntz")

TABLES = {
    "people": "person_id string, display_name string, aliases array<string>, is_user boolean, created_at timestamp_ntz",
    "aliases": "person_id string, alias string",
    "identities": "person_id string, kind string, value string",
    "messages": "id string, conversation_id string, person_id string, sender_label string, sent_at timestamp_ntz, "
                f"content string, attachments {_ATTACHMENTS}, reply_to string, source string, how string, "
                "one_to_one boolean, path string",
    "emails": "id string, person_id string, from_label string, from_address string, to array<string>, subject string, "
              "body string, sent_at timestamp_ntz, path string",
    "calendar": "id string, title string, starts_at timestamp_ntz, ends_at timestamp_ntz, location string, "
                "description string, participants array<string>, person_ids array<string>, path string",
    "notes": "id string, person_id string, title string, body string, noted_at timestamp_ntz, path string",
    "voice": "id string, person_id string, message_id string, filename string, transcript string, recorded_at timestamp_ntz, path string",
    "documents": "id string, filename string, title string, text string, mime_type string, path string",
    "media": "id string, filename string, filename_key string, kind string, mime_type string, size_bytes bigint, "
             "checksum string, path string, status string",
    "events": "id string, person_id string, kind string, source string, occurred_at timestamp_ntz, summary string, "
              "record_id string",
    "memories": "id string, person_id string, kind string, source string, occurred_at timestamp_ntz, text string, "
                "record_id string, citation string, topics array<string>",
    # Of the user's model; one row a text, whatever number of memories say it.
    "vectors": "text_key string, embedding array<float>",
    "suggestions": "id string, person_a_id string, person_b_id string, label string, source string, "
                   "confidence double, reason string, status string",
    "profiles": _PROFILE,
    # Added up per import batch; profiles are kept from them.
    "activity": "person_id string, source string, day timestamp_ntz, n bigint, last_at timestamp_ntz",
    "topic_days": "person_id string, topic string, day timestamp_ntz, n bigint, last_at timestamp_ntz",
    "processed": "checksum string, path string",
    "jobs": "id string, path string, checksum string, source string, status string, error string, imported bigint, "
            "version bigint",
    "provenance": "checksum string, filename string, record_count bigint",
    "feed": "topic string, key string, detail string",
    "commits": "at timestamp_ntz",
    # Of streams, numbered by their batches.
    "progress": "stream string, run_id string, started_at timestamp_ntz, input_rows bigint, batch_ms bigint, "
                "steps map<string,bigint>, state_rows bigint",
    "live_feed": "topic string, key string, detail string",
    "daily": "person_id string, day timestamp_ntz, n bigint, version bigint",
    "statuses": "person_id string, status string, reason string, version bigint",
    # Numbered by merges, not by import batches.
    "merges": "old_id string, new_id string",
    "labels": "id string, person_id string",
    "moves": "name string, moved bigint",
    "decisions": "id string, merge boolean",
    "merged_profiles": _PROFILE + ", after bigint",
}

KEYS = {"people": "person_id", "messages": "id", "emails": "id", "calendar": "id", "notes": "id", "voice": "id",
        "documents": "id", "media": "id", "events": "id", "memories": "id", "suggestions": "id"}

#: Tables that an import batch writes; they are read up to the last committed batch.
IMPORTED = ("people", "aliases", "identities", "messages", "emails", "calendar", "notes", "voice", "documents", "media", "events", "memories",
            "vectors", "suggestions", "profiles", "activity", "topic_days", "processed", "jobs", "provenance", "feed")

#: Tables parted by the month of a time.
DATED = {"messages": "sent_at", "emails": "sent_at", "calendar": "starts_at", "events": "occurred_at", "memories": "occurred_at"}

#: Tables parted by a hash of the person, so that an upkeep reads the parts of the people it touches.
SLOTTED = ("activity", "topic_days")
SLOTS = 64
