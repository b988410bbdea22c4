"""Directory layouts of archive formats, and readers of those with rules of their own, for toc.entries. All values here are fixed values of the formats."""

from __future__ import annotations

from .archives import READERS, Reader
from .toc import FLAT, Layout

LAYOUTS: dict[str, Layout | Reader] = READERS | {
    "flat": FLAT,
    "capcom_dlcp": Layout(big=True, count=(0x0C, "u32"), table=0x10, inline=(("name", "p8"), ("offset", "u32")), sized="next"),
    "spk": Layout(magic=b"\0ISF", count=(8, "u32"), table=0x10, stride=0x10, fields={"name_at": (0, "u32"), "offset": (4, "u32"), "size": (8, "u32")}),
    "tecmo_fhd": Layout(magic=b"\0DHF", count=(0x0C, "u32"), arrays={"size": (0x10, "u32"), "kind": (0x14, "u8"), "name": (0x1C, "zz"), "offset": (0x20, "u32")}, unit=0x800, skip=(0xFFFFFFFF,)),
    "loco_garc": Layout(magic=b"GARC", count=(0x14, 8, "u32"), table=(0x14, 0x10, "u32"), stride=0x18, fields={"size": (4, "u32"), "offset": (8, "u32"), "name_at": (0x0C, "u32")}),
    "loco_sector": Layout(magic=b"GIMG", count=(8, "u32"), table=0x0C, stride=0x10, fields={"name_at": (0, "u32"), "offset": (4, "u32"), "size": (0x0C, "u32")}, unit=0x800),
    "bigrp_midi": Layout(count=(8, "u32"), table=(0, "u32"), stride=(4, "u32"), fields={"kind": (8, "u32"), "offset": (0x10, "u32"), "size": (0x14, "u32")}, only={"kind": 2}, relative=True),
    "atomiswave": Layout(find=b"G1ROM FILESYSTEM", count=(0x10, "u32"), table=0x40, stride=0x40, fields={"offset": (8, "u32"), "size": (0x0C, "u32"), "name": (0x10, "s48")}, skip=(0,)),
    "koei_g1l": Layout(magic=b"_L1G", swapped=b"G1L_", count=(0x14, "u32"), table=0x18, stride=4, fields={"offset": (0, "u32")}, sized="next", once=True),
    "sector_offsets": Layout(stride=4, fields={"offset": (0, "u32")}, unit=0x800, sized="next", skip=(0xFFFFFFFF,)),
}
