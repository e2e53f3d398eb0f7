"""Pages of PDF files and images as text, around engines that are plugged in.

No model comes with this library. An engine is an object of ``Engine``'s methods, made anew in each task by the
function that the operators take; ``Stub`` answers from the images' own bytes, for tests. Everything around the
engine is here: rasters of a file's pages, small pictures that need no layout, the rules for boxes, text formats,
batches, and rows whose engine fails, which are empty and say why while the rest goes on.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafspark.functions import repetition, tables
from sheafspark.functions import text as T
from sheafspark.operators import boxes as B

PAGE = "doc_id string, page_id int, width int, height int, content binary, error string"
BOX = "doc_id string, page_id int, idx int, label string, score double, x1 double, y1 double, x2 double, y2 double, order_seq int"
#: Prompts by task; what a task's name must hold or be to have one.
PROMPTS = {"formula": "Formula Recognition:", "table": "Table Recognition:", "chart": "Chart Recognition:", "seal": "Seal Recognition:", "spotting": "Spotting:", "ocr": "OCR:"}
#: Fixed value: a page's longest side up to which it is one block of text.
SMALL_SIDE = 512


class Engine:
    """What a backend offers. Images are bytes; what a method isn't written for it refuses."""

    def pages(self, content: bytes, dpi: int) -> list[tuple[int, int, bytes]]:
        """(width, height, image) of each page of a file, at dpi / 72 of its size, in RGB, without annotations."""
        raise NotImplementedError

    def turned(self, images: list[bytes]) -> list[bytes]:
        """Images turned upright: by 270 clockwise, by 90 the other way, by 180."""
        return images

    def flattened(self, images: list[bytes]) -> list[bytes]:
        return images

    def layout(self, images: list[bytes]) -> list[list[tuple[str, float, float, float, float, float, int]]]:
        """(label, score, x1, y1, x2, y2, order) of each image's blocks."""
        raise NotImplementedError

    def texts(self, crops: list[tuple[bytes, tuple[int, int, int, int], str]]) -> list[str]:
        """Text of each (image, box, label)."""
        raise NotImplementedError

    def speech(self, clips: list[bytes]) -> list[str]:
        raise NotImplementedError


class Stub(Engine):
    """An engine that reads what an image's bytes say in JSON: {"pages": [...]} or {"width", "height", "blocks": [[label, score, x1, y1, x2, y2, order, text]...]}."""

    def pages(self, content, dpi):
        scale = dpi / 72
        return [(round(p["width"] * scale), round(p["height"] * scale), json.dumps(p).encode()) for p in json.loads(content).get("pages", [])]

    def layout(self, images):
        return [[tuple(b[:7]) for b in json.loads(i)["blocks"]] for i in images]

    def texts(self, crops):
        out = []
        for image, box, label in crops:
            own = json.loads(image)["blocks"]
            hit = [b[7] for b in own if b[0] == label and all(abs(float(x) - y) <= 1 for x, y in zip(b[2:6], box, strict=True))]
            out.append(hit[0] if hit else "\n".join(b[7] for b in own))
        return out

    def speech(self, clips):
        return [c.decode("utf-8", "replace") for c in clips]


def _batches(rows: list, size: int) -> Iterator[list]:
    for a in range(0, len(rows), size):
        yield rows[a : a + size]


def _safely(run: Callable[[list], list], rows: list, empty) -> tuple[list, str | None]:
    """What run makes of rows; where it fails, or answers for too few, an empty answer for each and why."""
    try:
        out = list(run(rows))
        if len(out) != len(rows):
            raise ValueError(f"{len(out)} answers for {len(rows)} rows")
        return out, None
    except Exception as e:  # noqa: BLE001: a batch that an engine can't do is empty, the others aren't
        return [empty] * len(rows), f"{type(e).__name__}: {e}"


def pages(files: DataFrame, engine: Callable[[], Engine], dpi: int = 200) -> DataFrame:
    """A row for each page of files (path, category pdf or image, content); a file that can't be read has one row with its error. An image is one page, whose size the engine's layout says if it must."""

    def run(parts):
        own = engine()
        for part in parts:
            out = []
            for path, category, raw in zip(part["path"], part["category"], part["content"], strict=True):
                try:
                    made = own.pages(bytes(raw), dpi) if category == "pdf" else [(*size_of(bytes(raw)), bytes(raw))]
                    out += [(path, i, w, h, x, None) for i, (w, h, x) in enumerate(made, 1)]
                except Exception as e:  # noqa: BLE001
                    out.append((path, 1, 0, 0, b"", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PAGE.split(", ")])

    return files.select("path", "category", "content").mapInPandas(run, PAGE)


def size_of(raw: bytes) -> tuple[int, int]:
    """Width and height of a PNG, GIF, BMP or JPEG image, or of a stub's; (0, 0) where they aren't found."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        return int.from_bytes(raw[16:20], "big"), int.from_bytes(raw[20:24], "big")
    if raw[:4] == b"GIF8":
        return int.from_bytes(raw[6:8], "little"), int.from_bytes(raw[8:10], "little")
    if raw[:2] == b"BM":
        return int.from_bytes(raw[18:22], "little"), abs(int.from_bytes(raw[22:26], "little", signed=True))
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(raw) and raw[at] == 0xFF:
            if 0xC0 <= raw[at + 1] <= 0xCF and raw[at + 1] not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(raw[at + 7 : at + 9], "big"), int.from_bytes(raw[at + 5 : at + 7], "big")
            at += 2 + int.from_bytes(raw[at + 2 : at + 4], "big")
        return 0, 0
    if raw[:1] == b"{":
        own = json.loads(raw)
        return int(own.get("width", 0)), int(own.get("height", 0))
    return 0, 0


def prepared(rows: DataFrame, engine: Callable[[], Engine], turn: bool = False, flatten: bool = False, batch: int = 8) -> DataFrame:
    """Pages turned upright and flattened, where asked for; a batch that fails stays as it is."""
    if not (turn or flatten):
        return rows

    def run(parts):
        own = engine()
        for part in parts:
            images = [bytes(x) for x in part["content"]]
            for step in [own.turned] * turn + [own.flattened] * flatten:
                images = [x for group in _batches(images, batch) for done, why in [_safely(step, group, None)] for x in (group if why else done)]
            yield part.assign(content=images)

    return rows.mapInPandas(run, rows.schema)


def layout(rows: DataFrame, engine: Callable[[], Engine], use_layout: bool = True, small_side: int = SMALL_SIDE, least_score: float = 0.3, batch: int = 8) -> DataFrame:
    """Boxes of pages, clipped to the page: one of text for a page without layout or of small sides, the engine's sure ones for the others. Pages of a failed batch have none."""

    def run(parts):
        own = engine()
        for part in parts:
            out = []
            for group in _batches(list(part.itertuples(index=False)), batch):
                ask = [p for p in group if use_layout and max(p.width, p.height) > small_side]
                found = dict(zip(((p.doc_id, p.page_id) for p in ask), _safely(own.layout, [bytes(p.content) for p in ask], [])[0], strict=True))
                for p in group:
                    for i, (label, score, x1, y1, x2, y2, order) in enumerate(found.get((p.doc_id, p.page_id), [] if p in ask else [("text", 1.0, 0, 0, p.width, p.height, 1)])):
                        if score >= least_score:
                            edge = lambda v, most: float(int(min(max(v, 0), most)))
                            out.append((p.doc_id, p.page_id, i, label, float(score), edge(x1, p.width), edge(y1, p.height), edge(x2, p.width), edge(y2, p.height), int(order)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BOX.split(", ")])

    return rows.filter("error is null").select("doc_id", "page_id", "width", "height", "content").mapInPandas(run, BOX)


def arranged(found: DataFrame, sizes: DataFrame, unclip: float | None = None, merge: str = "union", drop: tuple[str, ...] = (), keep: tuple[str, ...] = ("image", "seal", "chart")) -> DataFrame:
    """Boxes after the rules: overlaps, pictures as large as the page, boxes in others (merge: union keeps all, large the outer, small the inner ones), labels to drop, order, growth about their middle; order_id from 0 in a page."""
    page = ["doc_id", "page_id"]
    left = B.nms(found.withColumn("cls", F.col("label")), page, "idx").drop("cls")
    left = B.without_large(left, sizes, page)
    if merge != "union":
        left = B.without_nested(left, page, "idx", merge, keep)
    left = left.filter(~F.col("label").isin(list(drop))) if drop else left
    left = left.withColumn("order_id", (F.row_number().over(Window.partitionBy(*page).orderBy("order_seq", "idx")) - 1).cast("int"))
    if unclip:
        w, h, cx, cy = (F.col("x2") - F.col("x1")) * unclip, (F.col("y2") - F.col("y1")) * unclip, (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
        left = left.withColumns({"x1": cx - w / 2, "x2": cx + w / 2, "y1": cy - h / 2, "y2": cy + h / 2})
    return left


def recognised(found: DataFrame, rows: DataFrame, engine: Callable[[], Engine], style: str = "vl", batch: int = 16) -> DataFrame:
    """found with content: the engine's text of each box in its label's format; blocks of a failed batch are empty and say why."""
    asked = found.join(rows.select("doc_id", "page_id", F.col("content").alias("image")), ["doc_id", "page_id"])
    kind = ", ".join(f"`{c}` {t}" for c, t in found.dtypes) + ", content string, error string"

    def run(parts):
        own = engine()
        for part in parts:
            texts, why = [], []
            for group in _batches(list(part.itertuples(index=False)), batch):
                got, error = _safely(own.texts, [(bytes(r.image), (int(r.x1), int(r.y1), int(r.x2), int(r.y2)), r.label) for r in group], "")
                texts += [formatted(t, r.label, style) for t, r in zip(got, group, strict=True)] if error is None else got
                why += [error] * len(group)
            yield part.drop(columns="image").assign(content=texts, error=why)

    return asked.select(*found.columns, "image").mapInPandas(run, kind)


def page_texts(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, page_id and content of every page: the texts of its blocks that aren't blank, in order, a line each; a page without any is empty."""
    own = blocks.withColumn("content", T.collapse_newlines(F.col("content"))).filter("content <> ''")
    texts = own.groupBy("doc_id", "page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_id", "content"))), lambda b: b["content"]), "\n").alias("content"))
    return rows.select("doc_id", "page_id").join(texts, ["doc_id", "page_id"], "left").na.fill("", ["content"])


def read(files: DataFrame, engine: Callable[[], Engine], dpi: int = 200, turn: bool = False, flatten: bool = False, use_layout: bool = True, **rules) -> DataFrame:
    """Page texts of PDF files and images, batch or stream-batch: every step above."""
    rows = prepared(pages(files, engine, dpi), engine, turn, flatten)
    found = arranged(layout(rows, engine, use_layout), rows, **rules)
    return page_texts(recognised(found, rows, engine), rows)


def transcribed(clips: DataFrame, engine: Callable[[], Engine], batch: int = 8) -> DataFrame:
    """path, content and error of clips (path, content); those of a failed batch are empty and say why."""

    def run(parts):
        own = engine()
        for part in parts:
            for group in _batches(list(part.itertuples(index=False)), batch):
                got, why = _safely(own.speech, [bytes(r.content) for r in group], "")
                yield pd.DataFrame({"path": [r.path for r in group], "content": got, "error": [why] * len(group)})

    return clips.select("path", "content").mapInPandas(run, "path string, content string, error string")


# Texts and requests ----------------------------------------------------------------


def prompt(task: str) -> str:
    """The prompt of a task: of formulas where its name says so, of tables, charts and seals by name, else of plain text."""
    name = task.lower()
    return PROMPTS["formula" if "formula" in name else name if name in ("table", "chart", "seal") else "ocr"]


def formatted(text: str | None, label: str, style: str = "vl", table_least: int = 5000, least: int = 50) -> str:
    """An engine's text in its label's format. Styles: vl cuts runaway repetition first, remote doesn't, glm only knows titles and formulas."""
    text = text or ""
    if style == "vl":
        text = repetition.truncate(text, table_least if label == "table" else least)
    if label in ("doc_title", "paragraph_title"):
        return text if text.startswith("#") else f"# {text}"
    if "formula" in label:
        if style != "glm" and re.search(r"\\\(.*\\\)|\\\).*\\\(|\\\[.*\\\]|\\\].*\\\[", text, re.DOTALL):
            text = re.sub(r"\\\[(?:\\\[)?|\\\](?:\\\])?|\\[()]", lambda m: " $ " if m[0] == "\\(" else " $" if m[0] == "\\)" else " $$ ", text.replace("$", "")).strip()
        text = text if text.startswith("$$") else f"$$\n{text}"
        text = text if text.endswith("$$") else f"{text}\n$$"
        return text.replace("$", "") if style != "glm" and "formula_number" in label else text
    if "table" in label and style != "glm" and tables.OTSL.search(text):
        return tables.otsl_html(text)
    return text


def request(image: bytes, task: str, model: str, most_tokens: int | None = None, media: str = "image/jpeg") -> str:
    """The JSON of a chat request with one image and its task's prompt."""
    import base64

    uri = f"data:{media};base64,{base64.b64encode(image).decode()}"
    content = [{"type": "image_url", "image_url": {"url": uri}}, {"type": "text", "text": prompt(task)}]
    return json.dumps({"model": model, "messages": [{"role": "user", "content": content}], **({"max_tokens": most_tokens} if most_tokens else {})})


def data_uri(content, media):
    """Column: bytes as a data URI."""
    return F.concat(F.lit("data:"), media, F.lit(";base64,"), F.replace(F.replace(F.base64(content), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("")))


def from_data_uri(uri):
    """Column: the bytes of a data URI or of bare base64; null where they can't be decoded."""
    return F.try_to_binary(F.when(uri.startswith("data:"), F.element_at(F.split(uri, ","), -1)).otherwise(uri), F.lit("base64"))


def score(probabilities):
    """Column: the mean of a line's recognition scores, 0 for none."""
    return F.coalesce(F.aggregate(probabilities, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size(probabilities), F.lit(0)), F.lit(0.0))


def ctc_lines(predictions: np.ndarray, alphabet: str, blank: int = 0) -> tuple[str, float]:
    """Text and mean score of a line's [steps, symbols] predictions: the best symbol a step, repeats and blanks dropped."""
    best, sure = predictions.argmax(1), predictions.max(1)
    kept = [i for i, s in enumerate(best.tolist()) if s != blank and (not i or s != best[i - 1])]
    return "".join(alphabet[best[i] - 1] for i in kept), float(sure[kept].mean()) if kept else 0.0
