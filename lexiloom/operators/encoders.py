"""Presets of encoders: names, the identifiers that are kept with their vectors, and what they do to a model's vectors.

The models themselves aren't part of the library: `similarity.encode` takes any function from texts to vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column

from lexiloom.operators.similarity import quantized, reduced


@dataclass(frozen=True)
class Preset:
    """A kind of encoder, the model that it loads, and how its vectors are made smaller."""

    kind: str
    model: str
    dimensions: int | None = None
    numbers: str | None = None

    @property
    def identifier(self) -> str:
        """What is kept beside each vector, so that vectors of different encoders are never compared."""
        name = self.model.rsplit("/", 1)[-1]
        return ":".join([self.kind, name, *([f"d{self.dimensions}"] if self.dimensions else []), *([self.numbers] if self.numbers else [])])

    def applied(self, vector: Column) -> Column:
        """A model's vectors as this preset keeps them."""
        out = reduced(vector, self.dimensions) if self.dimensions else vector
        return quantized(out) if self.numbers == "int8" else out


# Presets by name.
PRESETS = {
    "calidad": Preset("torch", "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2"),
    "ligero": Preset("static", "minishlab/potion-multilingual-128M"),
    "ligero-256": Preset("static", "minishlab/potion-multilingual-128M", 256),
    "minimo": Preset("static", "minishlab/potion-multilingual-128M", 128, "int8"),
}


def named(identifier: str) -> str | None:
    """The name of the preset with this identifier, if there is one."""
    return {p.identifier: name for name, p in PRESETS.items()}.get(identifier)


def resolve(stored: str) -> Preset:
    """The encoder of a stored identifier, of a preset's name, or of the name of a sentence model. An identifier of no
    preset is an error: its vectors were made by other code."""
    name = named(stored) or stored
    if name in PRESETS:
        return PRESETS[name]
    if name.partition(":")[0] in {p.kind for p in PRESETS.values()} and ":" in name:
        raise ValueError(f"{stored} is the identifier of no known encoder; there are {', '.join(sorted(PRESETS))}")
    return Preset("torch", stored)
