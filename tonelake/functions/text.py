"""Text, key and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonelake.functions.constants import (
    ANONYMOUS_PREFIX,
    AUDIO_TYPES,
    ML_STAGES,
    NOTE_NAMES,
    RETRY_BASE_DELAY_S,
    TYPE_BY_EXTENSION,
)

# --- fixed values: accepted formats ---
USER_ID = r"^[A-Za-z0-9_-]{1,128}\z"
SEGMENT = r"^[A-Za-z0-9_.-]{1,128}\z"
PUSH_TOKEN = r"^Expo(nent)?PushToken\[[A-Za-z0-9_-]+\]\z"


def valid_user_id(user_id: Column) -> Column:
    return user_id.rlike(USER_ID)


def valid_segment(segment: Column) -> Column:
    """A key segment: the allowed characters, and never "." or ".."."""
    return segment.rlike(SEGMENT) & ~segment.isin(".", "..")


def user_prefix(user_id: Column) -> Column:
    """`users/<id>/`, or null for an id that could escape its prefix."""
    return F.when(valid_user_id(user_id), F.concat(F.lit("users/"), user_id, F.lit("/")))


def job_prefix(user_id: Column, job_id: Column) -> Column:
    return F.when(
        valid_segment(job_id), F.concat(user_prefix(user_id), F.lit("jobs/"), job_id, F.lit("/"))
    )


def object_key(user_id: Column, job_id: Column, stage: Column, name: Column) -> Column:
    return F.when(
        valid_segment(stage) & valid_segment(name),
        F.concat(job_prefix(user_id, job_id), stage, F.lit("/"), name),
    )


def blank_to_null(name: Column) -> Column:
    trimmed = F.regexp_replace(name, r"^\s+|\s+$", "")
    return F.when(trimmed != "", trimmed)


def cut_or_null(message: Column, length: int) -> Column:
    """The first `length` characters; null when nothing is left."""
    text = F.substring(F.coalesce(message, F.lit("")), 1, length)
    return F.when(text != "", text)


def export_name(title: Column, extension: Column, fallback: str = "Untitled score") -> Column:
    """A safe file name: letters, digits, space and `_ . -` kept, spaces squeezed, 80 characters."""
    kept = F.regexp_replace(title, r"[^\p{L}\p{N} _.\-]+", " ")
    base = F.substring(F.trim(F.regexp_replace(kept, r"\s+", " ")), 1, 80)
    return F.concat(
        F.when(F.coalesce(base, F.lit("")) != "", base).otherwise(F.lit(fallback)),
        F.lit("."),
        extension,
    )


def note_name(pitch: Column) -> Column:
    """"E4" for pitch 64."""
    names = F.array(*[F.lit(n) for n in NOTE_NAMES])
    octave = F.floor(pitch / 12) - 1
    return F.concat(F.element_at(names, (pitch % 12 + 1).cast("int")), octave.cast("string"))


def chord_label(root: Column, quality: Column) -> Column:
    names = F.array(*[F.lit(n) for n in NOTE_NAMES])
    return F.concat_ws(":", F.element_at(names, (root + 1).cast("int")), quality)


def upload_type(reported: Column, file_name: Column) -> Column:
    """The reported type if it is an accepted one, else by the file's extension, else null."""
    extension = F.lower(F.element_at(F.split(file_name, r"\."), -1))
    by_extension = F.create_map(
        *[F.lit(x) for pair in TYPE_BY_EXTENSION.items() for x in pair]
    )
    accepted = sorted({*TYPE_BY_EXTENSION.values(), "audio/x-m4a", "audio/x-wav", "audio/wave"})
    return F.when(reported.isin(accepted), reported).otherwise(by_extension[extension])


def stored_extension(content_type: Column) -> Column:
    types = F.create_map(*[F.lit(x) for pair in AUDIO_TYPES.items() for x in pair])
    return types[content_type]


def queue_of(stage: Column) -> Column:
    return F.when(stage.isin(*ML_STAGES), "ml").otherwise("cpu")


def retry_delay_s(attempt: Column) -> Column:
    """10 s after the first attempt, then four times longer each time."""
    return F.lit(RETRY_BASE_DELAY_S) * F.pow(F.lit(4.0), attempt - 1)


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def month_key(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def same_beats(a: Column, b: Column) -> Column:
    """Equality of "n/d" beat fractions, by cross-multiplying whole numbers."""

    def part(fraction: Column, i: int) -> Column:
        return F.coalesce(F.try_element_at(F.split(fraction, "/"), F.lit(i)), F.lit("1")).cast(
            "bigint"
        )

    return part(a, 1) * part(b, 2) == part(b, 1) * part(a, 2)


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of JSON with sorted keys, no spaces and explicit nulls."""
    record = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def pipeline_version(package: str, stage_versions: list[tuple[str, Column]]) -> Column:
    """`package+hash`, where the hash covers every stage's version."""
    joined = F.concat_ws(";", *[F.concat(F.lit(f"{n}="), v) for n, v in stage_versions])
    return F.concat(F.lit(f"{package}+"), F.substring(F.sha2(joined, 256), 1, 8))


def known_ids(ids: Column) -> Column:
    """Ids in first-seen order without repeats, anonymous ids or ones over 128 characters."""
    return F.array_distinct(
        F.filter(
            ids,
            lambda i: i.isNotNull()
            & (i != "")
            & ~i.startswith(ANONYMOUS_PREFIX)
            & (F.length(i) <= 128),
        )
    )


def notification_title(status: Column, name: Column, instrument: Column) -> Column:
    take = take_name(name, instrument)
    return F.when(status == "succeeded", "Your score is ready").otherwise(
        F.format_string("Couldn't transcribe “%s”", take)
    )


def notification_body(
    status: Column, name: Column, instrument: Column, error: Column
) -> Column:
    take = take_name(name, instrument)
    return F.when(
        status == "succeeded",
        F.format_string("“%s” is transcribed. Tap to see and hear it.", take),
    ).otherwise(F.coalesce(error, F.lit("Something went wrong.")))


def take_name(name: Column, instrument: Column) -> Column:
    default = F.when(instrument == "guitar", "Guitar take").otherwise("Piano take")
    return F.coalesce(F.when(name != "", name), default)


def is_audio(relative_key: Column) -> Column:
    """The upload, the normalised audio and a separated stem: what goes once a job is over."""
    stage = F.split(relative_key, "/", 2)[0]
    name = F.coalesce(F.try_element_at(F.split(relative_key, "/", 2), F.lit(2)), F.lit(""))
    sound = name.endswith(".flac") | name.endswith(".wav")
    return (stage == "source") | (stage.isin("normalize", "separate") & sound)
