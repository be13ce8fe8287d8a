"""Sources: plain text, EPUB, HTML, sound files, manifests, voice folders, track listings.

Every source is a DataFrame over ``binaryFile`` or text rows; parsing of binary formats runs in
Arrow-batched functions, one file at a time.
"""

import html.parser
import io
import re
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K

from quillmill.functions import text as T
from quillmill.functions.maths import js_round, track_seconds

# Upload formats and the size cap.
FORMATS = {".pdf": "pdf", ".txt": "txt", ".epub": "epub"}
SIZE_CAP = 50 * 1024 * 1024
# Named entities; others become a blank.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”"}
BLOCK_TAGS = set("p div section blockquote tr td th article".split())


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, length, content) of the files of known formats within the size cap."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)\z", 1))
    fmt = F.coalesce(*[F.when(ext == e, F.lit(f)) for e, f in FORMATS.items()])
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= SIZE_CAP).withColumn("format", fmt).where("format is not null").select("path", "format", "length", "content")


def txt(files: DataFrame) -> DataFrame:
    """(path, raw_text): UTF-8 without a leading mark."""
    return files.where("format = 'txt'").select("path", F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("raw_text"))


def decode_entities(text: str) -> str:
    """Hexadecimal, decimal, then named references; unknown names become a blank."""
    point = lambda n: chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else " "
    text = re.sub(r"&#[xX]([0-9a-fA-F]+);", lambda m: point(int(m[1], 16)), text)
    text = re.sub(r"&#(\d+);", lambda m: point(int(m[1])), text)
    return re.sub(r"&([A-Za-z][A-Za-z0-9]*);", lambda m: ENTITIES.get(m[1].lower(), " "), text)


class _Reader(html.parser.HTMLParser):
    """Tags to lines: headings, list items and paragraphs, each on its own line."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.out: list[tuple[str, str, int | None]] = []
        self.buffer: list[str] = []
        self.kind, self.level, self.skip = "p", None, 0
        self.lists: list[list] = []

    def flush(self) -> None:
        t = re.sub(r"\s+", " ", decode_entities("".join(self.buffer))).strip()
        self.buffer = []
        if t:
            if self.kind == "li":
                mark = "•"
                if self.lists and self.lists[-1][0] == "ol":
                    self.lists[-1][1] += 1
                    mark = f"{self.lists[-1][1]}."
                t = f"{mark} {t}"
            self.out.append((t, self.kind, self.level))
        self.kind, self.level = "p", None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "head", "title"):
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.kind, self.level = "h", min(int(tag[1]), 3)
        elif tag in ("ol", "ul"):
            self.flush()
            self.lists.append([tag, 0])
        elif tag == "li":
            self.flush()
            self.kind = "li"
        elif tag in BLOCK_TAGS:
            if not (self.kind == "li" and not "".join(self.buffer).strip()):
                self.flush()
        elif tag == "br":
            self.buffer.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head", "title"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("ol", "ul"):
            self.flush()
            if self.lists:
                self.lists.pop()
        elif tag == "li" or re.fullmatch("h[1-6]", tag) or tag in BLOCK_TAGS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.buffer.append(data)

    def handle_entityref(self, name: str) -> None:
        self.handle_data(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.handle_data(f"&#{name};")


def html_lines(markup: str) -> tuple[str, list[tuple[str, int]]]:
    """The text of a page in lines, and its headings with their levels.

    Blocks are parted by a blank line; items of one list stand on consecutive lines.
    """
    r = _Reader()
    r.feed(markup or "")
    r.close()
    r.flush()
    parts: list[str] = []
    before = None
    for line, kind, _ in r.out:
        parts.append(("" if before is None else "\n" if kind == before == "li" else "\n\n") + line)
        before = kind
    return "".join(parts), [(t, lv) for t, k, lv in r.out if k == "h"]


PAGE = K.StructType([K.StructField("text", K.StringType()), K.StructField("headings", K.ArrayType(K.StructType([K.StructField("line", K.StringType()), K.StructField("level", K.IntegerType())])))])


@F.pandas_udf(PAGE)
def html_page(s: pd.Series) -> pd.DataFrame:
    """struct<text, headings> of HTML; null gives empty text."""
    made = [html_lines(x) if x is not None else ("", []) for x in s]
    return pd.DataFrame({"text": [t for t, _ in made], "headings": [[{"line": a, "level": b} for a, b in h] for _, h in made]})


def strip_markup(c: Column | str) -> Column:
    """Text without scripts, styles, comments, prologs and tags, in the JVM alone."""
    x = T.col(c)
    for p in (r"(?is)<(script|style|head)\b.*?</\1\s*>", r"(?s)<!--.*?-->", r"(?s)<\?.*?\?>", r"(?is)<!doctype[^>]*>", r"(?s)<[^>]*>"):
        x = F.regexp_replace(x, p, " ")
    return T.collapse(x)


def epub(files: DataFrame) -> DataFrame:
    """(path, spine_idx, title, html) of every readable item of the spine, in order."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(path, i, t, h) for i, (t, h) in enumerate(_spine(bytes(content)))]
                except (zipfile.BadZipFile, KeyError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "spine_idx", "title", "html"])

    return files.where("format = 'epub'").select("path", "content").mapInPandas(run, "path string, spine_idx int, title string, html string")


def _spine(content: bytes) -> list[tuple[str | None, str]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        package = re.search(r'full-path="([^"]+)"', z.read("META-INF/container.xml").decode("utf-8", "replace"))[1]
        opf, base = z.read(package).decode("utf-8", "replace"), package.rpartition("/")[0]
        items = {}
        for m in re.finditer(r"<item\b[^>]*>", opf):
            a = dict(re.findall(r'([\w-]+)="([^"]*)"', m[0]))
            items[a.get("id")] = a.get("href", "")
        out = []
        for m in re.finditer(r'<itemref\b[^>]*idref="([^"]+)"', opf):
            name = f"{base}/{items.get(m[1], '')}".lstrip("/")
            if name in z.namelist():
                page = z.read(name).decode("utf-8", "replace")
                title = re.search(r"(?is)<title[^>]*>(.*?)</title>", page)
                out.append((decode_entities(title[1]).strip() if title else None, page))
        return out


def epub_books(files: DataFrame) -> DataFrame:
    """(path, raw_text): the pages in order, each under its title unless its first line says the same."""
    p = epub(files).withColumn("t", html_page("html")["text"]).where("t <> ''")
    first = F.split("t", "\n")[0]
    with_title = F.when((F.coalesce("title", F.lit("")) != "") & (T.heading_key("title") != T.heading_key(first)), F.concat("title", F.lit("\n\n"), "t")).otherwise(F.col("t"))
    return p.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("spine_idx", with_title.alias("x")))), lambda s: s["x"]), "\n\n").alias("raw_text"))


WAV = K.StructType(
    [K.StructField(c, K.IntegerType()) for c in ("format", "channels", "rate", "byte_rate", "bits", "data_offset")] + [K.StructField("data_bytes", K.LongType()), K.StructField("duration", K.DoubleType())]
)


def wav_info(buf: bytes) -> tuple | None:
    """Header fields of a sound file, found by walking its chunks; null for other files."""
    if len(buf) < 12 or buf[:4] != b"RIFF" or buf[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= min(len(buf), 65536):
        name, size = buf[at : at + 4], struct.unpack("<I", buf[at + 4 : at + 8])[0]
        if name == b"fmt ":
            fmt = struct.unpack("<HHIIHH", buf[at + 8 : at + 24])
        elif name == b"data" and fmt:
            data = len(buf) - at - 8 if size in (0, 0xFFFFFFFF) else size
            kind, channels, rate, byte_rate, _, bits = fmt
            return kind, channels, rate, byte_rate, bits, at + 8, data, data / byte_rate if byte_rate else 0.0
        at += 8 + size + size % 2
    return None


@F.pandas_udf(WAV)
def wav_header(s: pd.Series) -> pd.DataFrame:
    rows = [wav_info(bytes(b)) if b is not None else None for b in s]
    return pd.DataFrame([r or (None,) * 8 for r in rows], columns=WAV.names)


SAMPLES = K.StructType([K.StructField("samples", K.ArrayType(K.FloatType())), K.StructField("clipped", K.IntegerType()), K.StructField("peak", K.DoubleType())])


def wav_samples(buf: bytes) -> tuple[np.ndarray, int, float]:
    """Samples between -1 and 1 of PCM16 or float32, how many were out of range, and the raw peak."""
    info = wav_info(buf)
    if info is None or (info[0], info[4]) not in ((1, 16), (3, 32)) or info[1] < 1:
        return np.empty(0, np.float32), 0, 0.0
    raw = buf[info[5] : info[5] + info[6]]
    if info[0] == 1:
        x = np.frombuffer(raw[: len(raw) // 2 * 2], "<i2") / 32768
        return x.astype(np.float32), 0, float(np.abs(x).max(initial=0))
    x = np.nan_to_num(np.frombuffer(raw[: len(raw) // 4 * 4], "<f4"), nan=0.0)
    return np.clip(x, -1, 1), int((np.abs(x) > 1).sum()), float(np.abs(x).max(initial=0))


@F.pandas_udf(SAMPLES)
def decode_wav(s: pd.Series) -> pd.DataFrame:
    rows = [wav_samples(bytes(b)) if b is not None else (np.empty(0, np.float32), 0, 0.0) for b in s]
    return pd.DataFrame({"samples": [r[0].tolist() for r in rows], "clipped": [r[1] for r in rows], "peak": [r[2] for r in rows]})


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """A mono PCM16 file of samples: header of 44 bytes and data."""
    data = np.asarray(samples, "<i2").tobytes()
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", len(data)) + data


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Run manifests (JSON files) that name a key; unreadable files are left out."""
    schema = "key string, total int, voice string, speed double, title string, word_count int, started_at timestamp, test boolean"
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("m")).select("m.*").where("key is not null")


# The quality of a voice model and what an hour of its sound costs.
QUALITY_FACTORS = {"x_low": 0.12, "low": 0.16, "medium": 0.25, "high": 0.97}
MODEL = r"(?:^|/)([a-z]{2}_[A-Z]{2})-(.+)-(x_low|low|medium|high)\.onnx\z"


def model_files(files: DataFrame, described: dict[str, str] | None = None, groups: dict[str, str] | None = None) -> DataFrame:
    """(path, id, locale, name, quality, label, voice_group, speed_factor) of voice models that have a description beside them.

    described: what is said of a name; groups: what a locale is filed under. Files with odd names keep their name
    as label, in the group Other.
    """
    at = files.select("path")
    models = at.where(F.col("path").endswith(".onnx"))
    beside = at.where(F.col("path").endswith(".onnx.json")).select(F.expr("substring(path, 1, length(path) - 5)").alias("path"))
    lookup = lambda d, k: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), k) if d else F.lit(None).cast("string")
    part = lambda n: F.nullif(F.regexp_extract("path", MODEL, n), F.lit(""))
    m = models.join(beside.distinct(), "path", "left_semi").select("path", F.regexp_replace(F.regexp_extract("path", r"([^/]*)\z", 1), r"\.onnx\z", "").alias("id"), part(1).alias("locale"), part(2).alias("name"), part(3).alias("quality"))
    dashed = F.replace("locale", F.lit("_"), F.lit("-"))
    about = F.coalesce(lookup(described, F.col("name")), F.concat(dashed, F.lit(" Voice")))
    title = F.array_join(F.transform(F.split("name", "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10**6))), " ")
    odd = F.col("locale").isNull()
    label = F.when(odd, F.col("id")).otherwise(F.concat(title, F.lit(" | "), about, F.lit(" ("), F.col("quality"), F.lit(")")))
    return m.select(
        "path", "id", "locale", F.coalesce("name", "id").alias("name"), F.coalesce("quality", F.lit("unknown")).alias("quality"), label.alias("label"),
        F.when(odd, "Other").otherwise(F.coalesce(lookup(groups, F.col("locale")), dashed)).alias("voice_group"), lookup(QUALITY_FACTORS, F.col("quality")).alias("speed_factor"),
    )


def style_files(files: DataFrame, described: dict[str, str] | None = None) -> DataFrame:
    """(name, gender, label) of voices that are one style file (JSON) each; the first letter tells the gender."""
    f = files.where(F.col("path").endswith(".json")).select(F.regexp_extract("path", r"([^/]*)\.json\z", 1).alias("name"))
    about = F.element_at(F.create_map(*[F.lit(x) for kv in described.items() for x in kv]), F.col("name")) if described else F.lit(None).cast("string")
    return f.select("name", F.when(F.col("name").startswith("F"), "Female").otherwise("Male").alias("gender"), F.concat(F.lit("Supertonic "), "name", F.lit(" | "), F.coalesce(about, "name")).alias("label"))


def graded(spark: SparkSession, rows: list[tuple[str, str]], factor: float = 1.63) -> DataFrame:
    """(name, locale, gender, grade, place) of a fixed list of (name, grade): the name's first letters tell locale and gender, the best grade comes first."""
    d = spark.createDataFrame(rows, "name string, grade string")
    locale = F.when(F.substring("name", 1, 1) == "b", "en_GB").otherwise("en_US")
    gender = F.when(F.substring("name", 2, 1) == "f", "Female").otherwise("Male")
    # A+ before A before A-
    rank = F.concat(F.substring("grade", 1, 1), F.when(F.col("grade").endswith("+"), "0").when(F.col("grade").endswith("-"), "2").otherwise("1"))
    return d.select("name", locale.alias("locale"), gender.alias("gender"), "grade", F.row_number().over(Window.orderBy(rank, "name")).alias("place"), F.lit(factor).alias("speed_factor"))


def rendered_chunks(files: DataFrame, total: int) -> DataFrame:
    """(idx, path): one file for each chunk in range, compressed ones before plain.

    Files are named chunk-NNNN.flac or .wav, counted from 1, in any folder. A folder that also holds a chunk's
    measurements (chunk-NNNN.json) gives nothing: they would pass for work done here.
    """
    folder = F.regexp_replace("path", r"[^/]*\z", "")
    named = files.select("path", folder.alias("__dir"), F.lower(F.regexp_extract("path", r"(?i)chunk[-_]\d+\.(flac|wav|json)\z", 1)).alias("__ext"), F.regexp_extract("path", r"(?i)chunk[-_](\d+)\.(?:flac|wav|json)\z", 1).try_cast("int").alias("__n"))
    measured = named.where("__ext = 'json'").select("__dir").distinct()
    rows = named.where("__ext in ('flac', 'wav')").join(measured, "__dir", "left_anti").withColumn("idx", F.col("__n") - 1).where(F.col("idx").between(0, total - 1))
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy("idx").orderBy(F.col("__ext") == "wav", "path"))).where("__rn = 1").select("idx", "path")


# The JSON paths of a hit in four listings, and what they say of licences.
LISTINGS = {
    "pixabay": {"id": ("id", "audio_id"), "url": ("audio", "audio_url", "preview", "previewURL"), "title": ("title", "tags"), "author": ("user",), "page": ("pageURL",), "who": "Pixabay contributor", "license": "Pixabay Content License"},
    "freesound": {"id": ("id",), "url": ("previews.preview-hq-mp3", "previews.preview-lq-mp3"), "title": ("name",), "author": ("username",), "page": (), "who": "Unknown", "license": "CC0"},
    "ccmixter": {"id": ("upload_id",), "url": ("files[0].download_url",), "title": ("upload_name",), "author": ("user_name",), "page": ("file_page_url",), "who": "Unknown", "license": "CC BY"},
    "openverse": {"id": ("id",), "url": ("url",), "title": ("title",), "author": ("creator",), "page": ("foreign_landing_url", "detail_url"), "who": "Unknown", "license": "CC0"},
}


def listing_tracks(hits: DataFrame) -> DataFrame:
    """(provider, id, title, author, duration_sec, license, attribution, page_url, audio_url) of hits (provider, hit) of the four listings.

    Hits without an id or sound are left out, and so are those of two listings whose tags name a voice. Titles end
    after 90 characters; those of files lose the extension.
    """
    out = None
    for provider, p in LISTINGS.items():
        h = hits.where(F.col("provider") == provider)
        get = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object("hit", f"$.{x}" if "-" not in x else "$." + x.split(".")[0] + "['" + x.split(".")[1] + "']"), F.lit("")) for x in paths]) if paths else F.lit(None).cast("string")
        name = F.coalesce(get(*p["title"]), F.lit("Untitled") if provider == "openverse" else F.concat(F.lit(f"{provider.capitalize() if provider != 'ccmixter' else 'ccMixter'} "), get(*p["id"])))
        if provider == "freesound":
            name = F.regexp_replace(name, r"(?i)\.[a-z0-9]+\z", "")
        title, author = F.substring(name, 1, 90), F.coalesce(get(*p["author"]), F.lit(p["who"]))
        d = get("duration").try_cast("double")
        seconds = {"pixabay": d, "freesound": js_round(d), "openverse": js_round(d / 1000), "ccmixter": track_seconds(F.coalesce(get("files[0].file_format_info.ps"), F.lit("")), get("files[0].file_rawsize").try_cast("double"))}[provider]
        licence, credit, page = F.lit(p["license"]), F.lit(None).cast("string"), get(*p["page"])
        if provider == "ccmixter":
            licence = F.coalesce(get("license_name"), licence)
            credit = F.concat(F.lit('"'), title, F.lit('" by '), author, F.lit(" ("), F.coalesce(get("license_url"), F.lit("https://creativecommons.org/licenses/by/3.0/")), F.lit(")"))
            page = F.coalesce(page, F.concat(F.lit("http://ccmixter.org/files/"), author, F.lit("/"), get("upload_id")))
        elif provider == "openverse":
            licence = F.concat(F.upper(F.coalesce(get("license"), F.lit("cc0"))), F.coalesce(F.concat(F.lit(" "), get("license_version")), F.lit("")))
            page = F.coalesce(page, F.lit(""))
        elif provider == "pixabay":
            page = F.coalesce(page, F.concat(F.lit("https://pixabay.com/music/-"), get(*p["id"]), F.lit("/")))
        else:
            page = F.concat(F.lit("https://freesound.org/s/"), get("id"), F.lit("/"))
        tags = {"freesound": get("tags"), "ccmixter": F.concat_ws(",", get("upload_tags"), get("upload_extra.usertags"))}.get(provider)
        made = h.select(F.lit(provider).alias("provider"), get(*p["id"]).alias("id"), title.alias("title"), author.alias("author"), F.coalesce(seconds.cast("double"), F.lit(0.0)).alias("duration_sec"), licence.alias("license"), credit.alias("attribution"), page.alias("page_url"), get(*p["url"]).alias("audio_url"), (T.has_vocal_tag(tags) if tags is not None else F.lit(False)).alias("__v"))
        made = made.where("id is not null and audio_url is not null and not __v").drop("__v")
        out = made if out is None else out.unionByName(made)
    return out


# Models that write no text.
NOT_A_WRITER = r"(?i)safety|guard|code|coder"


def models(hits: DataFrame) -> DataFrame:
    """(id, free, context, max_output, format, effort) of a model list (hit): what each can do by its parameters."""
    m = hits.select(F.from_json("hit", "id string, context_length bigint, supported_parameters array<string>, top_provider struct<max_completion_tokens:bigint>").alias("m")).select("m.*").where("id is not null")
    has = lambda p: F.coalesce(F.array_contains("supported_parameters", p), F.lit(False))
    form = F.when(has("structured_outputs"), "strict").when(has("response_format"), "object").otherwise("prompt")
    return m.select("id", F.col("id").endswith(":free").alias("free"), F.coalesce("context_length", F.lit(0)).alias("context"), F.nullif("top_provider.max_completion_tokens", F.lit(0)).alias("max_output"), form.alias("format"), has("reasoning_effort").alias("effort"))


def free_writers(models_: DataFrame, least: int = 32_000) -> DataFrame:
    """models with ``place``: the free ones that write, with room enough; strict formats first, then the most room."""
    ok = models_.where(F.col("free") & (F.col("context") >= least) & ~F.col("id").rlike(NOT_A_WRITER))
    return ok.withColumn("place", F.row_number().over(Window.orderBy((F.col("format") == "strict").desc(), F.col("context").desc(), "id")))


def total_seconds(files: DataFrame) -> DataFrame:
    """(seconds): how long all sound files of (content) are together; files of another kind count for nothing."""
    return files.select(wav_header("content").alias("h")).agg(F.coalesce(F.sum("h.duration"), F.lit(0.0)).alias("seconds"))


def tracks(payloads: DataFrame, provider: str, fields: dict[str, str]) -> DataFrame:
    """One schema for the hits of any listing: ``fields`` maps its columns to JSON paths of a hit.

    Hits without an id are left out, titles cut to 90 characters, durations null when not positive.
    """
    get = lambda k: F.get_json_object("hit", fields[k]) if k in fields else F.lit(None).cast("string")
    d = F.expr("cast(null as double)") if "duration" not in fields else get("duration").cast("double")
    out = payloads.select(F.lit(provider).alias("provider"), get("id").alias("id"), F.substring(F.coalesce(F.nullif(T.trim(get("title")), F.lit("")), F.lit("Untitled")), 1, 90).alias("title"), F.coalesce(get("author"), F.lit("Unknown")).alias("author"),
                          F.when(d > 0, d).alias("duration_sec"), get("license").alias("license"), get("page_url").alias("page_url"), F.lower(get("tags")).alias("tags"))
    return out.where("id is not null")


def screened(tracks_: DataFrame, shortest: int = 90, longest: int = 900, flatness: float = 6.0, spread: float = 16.0) -> DataFrame:
    """tracks with ``reason``: the first test a track fails, null when it passes; what is unmeasured passes."""
    reason = F.coalesce(
        F.when(~F.col("duration_sec").between(shortest, longest), F.lit("duration")),
        F.when(F.col("flatness_db") > flatness, F.lit("flatness")),
        F.when(F.col("range_db") > spread, F.lit("range")),
    )
    return tracks_.withColumn("reason", reason)


def screened_order() -> list[Column]:
    """Measured tracks first, the flattest before; the rest as they came."""
    return [F.col("flatness_db").isNull(), F.col("flatness_db"), F.col("ord")]
