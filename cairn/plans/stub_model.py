"""A model that answers by rule, where no service is at hand: for tests and for the registered queries."""

from __future__ import annotations

import json
from dataclasses import dataclass

from cairn.operators.extract import Unreachable


@dataclass(frozen=True)
class StubModel:
    """An image is ``<id>`` or ``<id>/<tile>`` as text; how it is answered depends on the id modulo 7.

    0: the gate sees no text. 1: nothing usable but of tiles 0 and 2. 2: usable at the second temperature. 3: never usable.
    4: no text after all. Others: text at once.
    """

    name: str = "stub"
    reachable: bool = True

    def _kind(self, image: bytes) -> tuple[int, str]:
        if not self.reachable:
            raise Unreachable("no service")
        number, _, tile = image.decode().partition("/")
        return int(number) % 7, tile

    def gate(self, image: bytes) -> str:
        kind, _ = self._kind(image)
        return "perhaps" if kind == 3 else json.dumps({"has_text": kind != 0, "context": "seen", "category": "Scene"})

    def extract(self, image: bytes, temperature: float) -> str:
        kind, tile = self._kind(image)
        if kind == 3 or (kind == 1 and tile not in ("0", "2")) or (kind == 2 and temperature == 0):
            return "loop loop loop"
        text = "" if kind == 4 else f"t{image.decode()}"
        return "Here: " + json.dumps({"has_text": kind != 4, "text": text, "context": "c", "text_kind": "sign", "language": "en", "category": "A  Sign"})

    def tiles(self, image: bytes) -> list[bytes]:
        return [image + b"/%d" % i for i in range(4)]

    def match_people(self, images: list[bytes], profiles: str) -> str:
        first = int(images[0])
        known = [p["person_id"] for p in json.loads(profiles)]
        return json.dumps({"matches": [{"person_id": p, "present": (first + p) % 2 == 0, "confidence": first % 10 / 10} for p in known]})

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(len(t.split("\n")[-1]))] for t in texts]
