"""Images and pages: tables of pixels as PNG files, and PNG files as pages of one PDF for each target, with bookmarks."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import folder_of

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def png(image: np.ndarray) -> bytes:
    """The file of an image of (height, width, 3) bytes."""
    height, width, _ = image.shape
    raw = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], axis=1).tobytes()
    chunks = ((b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)), (b"IDAT", zlib.compress(raw, 6)), (b"IEND", b""))
    return SIGNATURE + b"".join(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)) for kind, body in chunks)


def png_stream(data: bytes) -> tuple[int, int, bytes]:
    """(width, height, compressed rows) of such a file, as a PDF takes them."""
    at, size, rows = len(SIGNATURE), (0, 0), []
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            *size, depth, color, _, _, woven = struct.unpack(">IIBBBBB", body)
            if (depth, color, woven) != (8, 2, 0):
                raise ValueError("only images of three bytes a pixel, row by row")
        elif kind == b"IDAT":
            rows.append(body)
        at += 12 + n
    return *size, b"".join(rows)


def write_png(pixels: DataFrame, folder: str, name: str, height: int, width: int, background: tuple[int, int, int] = (0, 0, 0)) -> int:
    """A file <name>.png for each value of a column from (name, y, x, r, g, b); how many were written. An image is one group,
    bounded by its height and width."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.empty((height, width, 3), np.uint8)
        image[:] = background
        inside = pdf[(pdf.y >= 0) & (pdf.y < height) & (pdf.x >= 0) & (pdf.x < width)]
        image[inside.y, inside.x] = inside[["r", "g", "b"]].to_numpy(np.uint8)
        fs, base = folder_of(folder)
        fs.create_dir(base, recursive=True)
        key, draft = str(pdf["name"].iloc[0]), f"{base}/_{uuid.uuid4().hex}"
        with fs.open_output_stream(draft, compression=None) as f:
            f.write(png(image))
        fs.move(draft, f"{base}/{key}.png")
        return pd.DataFrame({"name": [key]})

    return pixels.select(F.col(name).cast("string").alias("name"), "y", "x", "r", "g", "b").groupBy("name").applyInPandas(run, "name string").count()


def literal(text: str) -> bytes:
    return b"(" + text.encode("cp1252", "replace").replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)") + b")"


class Pdf:
    """A document written page by page: what is held are places of objects and bookmarks, not pages."""

    def __init__(self, out, title: str, width: float, height: float) -> None:
        self.out, self.title, self.size, self.at, self.places = out, title, (width, height), 0, {}
        self.pages: list[int] = []
        self.marks: list[tuple[str, int | None]] = []
        self.last = 3  # 1: catalogue, 2: pages, 3: font
        self._put(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n")
        self._object(3, b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold /Encoding /WinAnsiEncoding >>")

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _object(self, number: int, body: bytes, stream: bytes | None = None) -> None:
        self.places[number] = self.at
        if stream is not None:
            body = body[:-2] + b"/Length %d >>\nstream\n" % len(stream) + stream + b"\nendstream"
        self._put(b"%d 0 obj\n" % number + body + b"\nendobj\n")

    def _new(self) -> int:
        self.last += 1
        return self.last

    def page(self, lines: list[tuple[float, float, str]], images: list[tuple[float, float, float, float, bytes]], bookmark: str, under: int | None) -> None:
        """lines: (x, y, text); images: (x, y, width, height, PNG file); both from the top left. under: the page whose bookmark holds this one's."""
        names, drawn = [], []
        for x, y, w, h, data in images:
            width, height, rows = png_stream(data)
            names.append(self._new())
            head = f"<< /Type /XObject /Subtype /Image /Width {width} /Height {height} /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode /DecodeParms << /Predictor 15 /Colors 3 /BitsPerComponent 8 /Columns {width} >> >>"
            self._object(names[-1], head.encode(), rows)
            drawn.append(f"q {w:g} 0 0 {h:g} {x:g} {self.size[1] - y - h:g} cm /I{names[-1]} Do Q".encode())
        drawn += [b"BT /F 32 Tf %g %g Td " % (x, self.size[1] - y) + literal(text) + b" Tj ET" for x, y, text in lines]
        content = self._new()
        self._object(content, b"<< >>", b"\n".join(drawn))
        self.pages.append(self._new())
        uses = " ".join(f"/I{n} {n} 0 R" for n in names)
        self._object(self.pages[-1], f"<< /Type /Page /Parent 2 0 R /Contents {content} 0 R /Resources << /Font << /F 3 0 R >> /XObject << {uses} >> >> >>".encode())
        self.marks.append((bookmark, under))

    def close(self) -> None:
        top, numbers = self._new(), [self._new() for _ in self.marks]
        root = self._new()
        children: dict[int | None, list[int]] = {}
        for k, (_, under) in enumerate(self.marks):
            children.setdefault(under, []).append(k)

        def family(of: int | None) -> str:
            mine = children.get(of, [])
            return f" /First {numbers[mine[0]]} 0 R /Last {numbers[mine[-1]]} 0 R /Count {len(mine)}" if mine else ""

        self._object(root, f"<< /Type /Outlines /First {top} 0 R /Last {top} 0 R /Count 1 >>".encode())
        first = f" /Dest [{self.pages[0]} 0 R /Fit]" if self.pages else ""
        self._object(top, b"<< /Title " + literal(self.title) + f" /Parent {root} 0 R{first}{family(None)} >>".encode())
        for under, mine in children.items():
            parent = top if under is None else numbers[under]
            for place, k in enumerate(mine):
                beside = (f" /Prev {numbers[mine[place - 1]]} 0 R" if place else "") + (f" /Next {numbers[mine[place + 1]]} 0 R" if place + 1 < len(mine) else "")
                self._object(numbers[k], b"<< /Title " + literal(self.marks[k][0]) + f" /Parent {parent} 0 R /Dest [{self.pages[k]} 0 R /Fit]{beside}{family(k)} >>".encode())
        self._object(2, f"<< /Type /Pages /Kids [{' '.join(f'{p} 0 R' for p in self.pages)}] /Count {len(self.pages)} /MediaBox [0 0 {self.size[0]:g} {self.size[1]:g}] >>".encode())
        self._object(1, f"<< /Type /Catalog /Pages 2 0 R /Outlines {root} 0 R /PageMode /UseOutlines >>".encode())
        table = self.at
        places = "".join(f"{self.places[k]:010d} 00000 n \n" for k in range(1, self.last + 1))
        self._put(f"xref\n0 {self.last + 1}\n0000000000 65535 f \n{places}trailer\n<< /Size {self.last + 1} /Root 1 0 R >>\nstartxref\n{table}\n%%EOF\n".encode())


PAGES = "name string, position int, bookmark string, line string, lines array<string>, images array<string>"
#: Where a page's images and lines stand, in points: (x, y, width, height) and (x, y).
PLACES = ((0, 0, 1427, 668), (0, 668, 1427, 668), (0, 1336, 1427, 668), (1427, 668, 1427, 668), (1427, 1336, 1427, 668))
LINES = ((1500, 50), (1500, 100), (1500, 150))


def write_pdf(pages: DataFrame, folder: str, *, size: tuple[float, float] = (2854, 2004), places: tuple = PLACES, lines: tuple = LINES) -> DataFrame:
    """(name, pages) of the documents written: a file <name>.pdf for each name, from pages (see ``PAGES``) in order of position; images are
    PNG files' addresses. A bookmark stands under the first one of its ``line``. A task holds one page's images at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = folder_of(folder)
        fs.create_dir(base, recursive=True)
        name, pdf, out, draft, first = None, None, None, "", {}

        def finish() -> pa.RecordBatch:
            pdf.close()
            out.close()
            fs.move(draft, f"{base}/{name}.pdf")
            return pa.record_batch({"name": pa.array([name]), "pages": pa.array([len(pdf.pages)], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                if row["name"] != name:
                    if pdf is not None:
                        yield finish()
                    name, draft, first = row["name"], f"{base}/_{uuid.uuid4().hex}", {}
                    out = fs.open_output_stream(draft, compression=None, buffer_size=1 << 20)
                    pdf = Pdf(out, name, *size)
                images = []
                for place, path in zip(places, row["images"] or [], strict=False):
                    store, where = folder_of(path)
                    with store.open_input_file(where) as f:
                        images.append((*place, f.read()))
                texts = [(*at, text) for at, text in zip(lines, row["lines"] or [], strict=False)]
                pdf.page(texts, images, row["bookmark"] or "", first.get(row["line"]))
                if row["line"] is not None:
                    first.setdefault(row["line"], len(pdf.pages) - 1)
        if pdf is not None:
            yield finish()

    sorted_ = pages.select(*[c.split()[0] for c in PAGES.split(", ")]).repartition("name").sortWithinPartitions("name", "position")
    return sorted_.mapInArrow(run, "name string, pages long")
