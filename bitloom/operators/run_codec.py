"""Masks as coded runs: labels under the order-2 label model, lengths under the run-length model, whole frequencies into the arithmetic coder.

A row's runs are coded until they fill its width, so no number of runs is sent. The models are counts, which start from training runs;
``online`` adds each row's runs to the counts once the row is coded, on both sides alike."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codecs import TOTAL, Decoder, Encoder, container, split_container

#: Labels that a model holds at most, and widths that a row has at most: the bounds of the tables that go to the workers.
MOST_LABELS, MOST_WIDTH = 4096, 32768
MODES = ("pretrained", "online")


@dataclass(frozen=True)
class Estimates:
    """The added counts of labels (alpha) and lengths (beta), and the weight of a label's own lengths against all."""

    alpha: float = 0.5
    beta: float = 0.5
    own: float = 0.95


@dataclass
class RunModel:
    """Probabilities of a run's label after the label before it, and of its length among those that fit the row.

    Labels are places in ``labels``; pairs: (place before or -1, place) to counts; lengths: place to counts of the lengths from 1 on."""

    labels: list[int]
    width: int
    pairs: dict[int, np.ndarray] = field(default_factory=dict)
    lengths: dict[int, np.ndarray] = field(default_factory=dict)
    by: Estimates = Estimates()

    def __post_init__(self):
        if len(self.labels) > MOST_LABELS or self.width > MOST_WIDTH:
            raise ValueError(f"{len(self.labels)} labels and a width of {self.width} are beyond {MOST_LABELS} and {MOST_WIDTH}")
        self.every = sum(self.lengths.values(), np.zeros(self.width, np.int64))

    def copy(self) -> RunModel:
        return RunModel(self.labels, self.width, {k: v.copy() for k, v in self.pairs.items()}, {k: v.copy() for k, v in self.lengths.items()}, self.by)

    def digest(self) -> str:
        """A name of everything that coding depends on."""
        known = hashlib.sha256(json.dumps([self.labels, self.width, self.by.alpha, self.by.beta, self.by.own]).encode())
        for counts in (self.pairs, self.lengths):
            for key in sorted(counts):
                known.update(f"{key}:".encode() + counts[key].astype("<i8").tobytes())
        return known.hexdigest()

    def label_chances(self, before: int) -> np.ndarray:
        added = self.pairs.get(before, 0) + np.full(len(self.labels), self.by.alpha)
        return added / added.sum()

    def length_chances(self, place: int, room: int) -> np.ndarray:
        """Chances of the lengths 1 to room, which sum to 1."""
        part = lambda counts: (counts[:room] + self.by.beta) / (counts.sum() + self.by.beta * self.width)
        mixed = part(self.every)
        if place in self.lengths:
            mixed = self.by.own * part(self.lengths[place]) + (1 - self.by.own) * mixed
        return mixed / mixed.sum()

    def learn(self, row: list[tuple[int, int]]) -> None:
        before = -1
        for place, n in row:
            self.pairs.setdefault(before, np.zeros(len(self.labels), np.int64))[place] += 1
            self.lengths.setdefault(place, np.zeros(self.width, np.int64))[n - 1] += 1
            self.every[n - 1] += 1
            before = place


def starts(chances: np.ndarray) -> np.ndarray:
    """Where each symbol's whole frequency starts, and the total at the end; no frequency is 0."""
    sizes = 1 + np.floor(chances * (TOTAL - len(chances))).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)])


def encode(rows: list[list[tuple[int, int]]], model: RunModel, width: int, online: bool) -> tuple[bytes, float, float]:
    """(payload, label bits, length bits) of rows of runs (place, length); the bits are those of the chances before rounding."""
    model = model.copy() if online else model
    coder, label_bits, length_bits = Encoder(), 0.0, 0.0

    def put(chances: np.ndarray, at: int) -> float:
        cut = starts(chances)
        coder.put(int(cut[at]), int(cut[at + 1] - cut[at]), int(cut[-1]))
        return -float(np.log2(chances[at]))

    for row in rows:
        before, x = -1, 0
        for place, n in row:
            label_bits += put(model.label_chances(before), place)
            length_bits += put(model.length_chances(place, width - x), n - 1)
            before, x = place, x + n
        if x != width:
            raise ValueError(f"a row's runs hold {x} of {width} pixels")
        if online:
            model.learn(row)
    return coder.done(), label_bits, length_bits


def decode(payload: bytes, model: RunModel, height: int, width: int, online: bool) -> list[list[tuple[int, int]]]:
    model = model.copy() if online else model
    coder, rows = Decoder(payload), []

    def get(chances: np.ndarray) -> int:
        cut = starts(chances)
        return coder.get(cut.tolist(), int(cut[-1]))

    for _ in range(height):
        row, before, x = [], -1, 0
        while x < width:
            before = get(model.label_chances(before))
            row.append((before, get(model.length_chances(before, width - x)) + 1))
            x += row[-1][1]
        rows.append(row)
        if online:
            model.learn(row)
    return rows


def to_file(rows: list[list[tuple[int, int]]], model: RunModel, width: int, mode: str) -> tuple[bytes, int, float, float]:
    """(data, bytes of the payload in it, label bits, length bits): the header names the size, the mode and the model."""
    payload, *bits = encode(rows, model, width, mode == "online")
    header = {"h": len(rows), "w": width, "mode": mode, "model": model.digest()}
    return container(json.dumps(header, sort_keys=True).encode(), payload), len(payload), *bits


def from_file(data: bytes, model: RunModel, mode: str) -> list[list[tuple[int, int]]]:
    """The rows of a file; one that another model or mode has made is an error."""
    raw, payload = split_container(data)
    header = json.loads(raw)
    if header["mode"] != mode or header["model"] != model.digest():
        raise ValueError("the file was coded with another mode or model")
    return decode(payload, model, header["h"], header["w"], mode == "online")


def fitted(train: DataFrame, run_rows: DataFrame, by: Estimates = Estimates()) -> RunModel:
    """Counts of training runs (image, y, run_idx, len, label); labels and width are those of run_rows, train being a part of it.

    What comes to the driver are distinct (label before, label) and (label, length), bounded by MOST_LABELS and MOST_WIDTH."""
    from .entropy import label_contexts

    labels = sorted(r.label for r in run_rows.select("label").distinct().limit(MOST_LABELS + 1).collect())
    width = run_rows.agg(F.max(F.col("start_x") + F.col("len"))).first()[0] or 1
    model = RunModel([int(x) for x in labels], int(width), by=by)
    place = {x: k for k, x in enumerate(model.labels)} | {-1: -1}
    for r in label_contexts(train, 2).groupBy("p1", "label").agg(F.count("*").alias("n")).collect():
        model.pairs.setdefault(place[r.p1], np.zeros(len(labels), np.int64))[place[r.label]] = r.n
    for r in train.groupBy("label", "len").agg(F.count("*").alias("n")).collect():
        model.lengths.setdefault(place[r.label], np.zeros(model.width, np.int64))[r.len - 1] = r.n
    model.__post_init__()
    return model


def coded(run_rows: DataFrame, model: RunModel, modes: tuple[str, ...] = MODES) -> DataFrame:
    """(image, mode, h, w, n_runs, label_bits, ideal_bits, payload_bytes, header_bytes, equal) of runs (image, y, run_idx, len, label): each image is coded, decoded and held against itself.

    An image's runs are gathered in one row; images are coded side by side."""
    part = F.sort_array(F.collect_list(F.struct("y", "run_idx", "label", "len")))
    images = run_rows.groupBy("image").agg(part.alias("p")).select("image", *(F.col(f"p.{c}").alias(c) for c in ("y", "label", "len")))

    def code(frames):
        place = {x: k for k, x in enumerate(model.labels)}
        names = ["image", "mode", "h", "w", "n_runs", "label_bits", "ideal_bits", "payload_bytes", "header_bytes", "equal"]
        for frame in frames:
            out = []
            for image, ys, labels, lengths in zip(*(frame[c] for c in ("image", "y", "label", "len")), strict=True):
                rows: dict[int, list] = {}
                for y, label, n in zip(ys, labels, lengths, strict=True):
                    rows.setdefault(int(y), []).append((place[int(label)], int(n)))
                held = list(rows.values())
                width = sum(n for _, n in held[0])
                for mode in modes:
                    data, size, label_bits, length_bits = to_file(held, model, width, mode)
                    out.append((image, mode, len(held), width, len(ys), label_bits, label_bits + length_bits, size, len(data) - size, from_file(data, model, mode) == held))
            yield pd.DataFrame(out, columns=names)

    return images.mapInPandas(code, "image long, mode string, h long, w long, n_runs long, label_bits double, ideal_bits double, payload_bytes long, header_bytes long, equal boolean")
