"""How each vendor's pages are laid out. All of it is parameters; the values below are defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Layout:
    label: str
    company: str
    manual: str
    body_box: tuple[float, float, float, float]
    running: tuple[str, ...]  # patterns of headers and footers, matched at the start
    title_size: float
    tiers: tuple[tuple[float, int], ...]  # (least size, heading level)
    bullets: tuple[tuple[str, str], ...]
    starts_at_once: bool = False
    references: tuple[tuple[str, str], ...] = ()  # rewrites of references to pages: pattern, replacement


# How page references are written in the three layouts, and what becomes of them.
REFERENCES = {
    "alpha": (("，", "、"), ("．", "。"), (r"[\ue000-\uf8ff]\s*(\d+)ページ\s*", "→ "), (r"\(?(\d+)ページ\s+", "→ ")),
    "gamma": ((r"\s*[（(]P\.[0-9A-Za-z\-]+[）)]", ""), (r"^l\s+", "- ")),
    "beta": ((r"[（(]\s*\d+ページ\s*[）)]", ""), (r"「?\d+ページ\s+", "→ "), (r"^参\s+考\s*[：:]?\s*", "**参考**: "), (r"参\s+考", "")),
}

# Body areas, running lines, font sizes and bullets of the three layouts.
LAYOUTS = {
    "alpha": Layout("Alpha Works", "Alpha", "Manual alpha", (35, 42, 545, 782), (r"\d+\s*$", r"MEMO$"), 15.0, ((12.6, 2), (11.6, 3), (10.5, 4)), (("●", "- "), ("・", "  - ")), references=REFERENCES["alpha"]),
    "beta": Layout("Beta Studio", "Beta", "Manual beta", (30, 50, 480, 700), (r"\d+-\d+\s*$", r"\d+\s*$", r"MEMO$"), 16.0, ((11.5, 2), (10.4, 3)), (("●", "- "), ("・", "  - ")), True, REFERENCES["beta"]),
    "gamma": Layout("Gamma Studio", "Gamma", "Manual gamma", (40, 55, 500, 788), (r"\d+-\d+\s*$", r"\d+\s*$", r"付\s*-\s*\d+$", r"A-\d+\s*$", r"MEMO$"), 17.0, ((13.2, 2), (11.5, 3)), (("l", "- "), ("●", "- "), ("・", "  - ")), references=REFERENCES["gamma"]),
}

# Private-use glyphs. Runs of (first code point, what the run stands for), then single ones, which come first.
GLYPH_RUNS = {"alpha": ((0xF0A1, [f"[F{i}]" for i in range(1, 13)]), (0xF041, [f"[{c}]" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]), (0xF030, [f"[{c}]" for c in "0123456789"]), (0xF0F1, list("①②③④⑤⑥⑦⑧⑨")))}
GLYPHS_COMMON = {0xF0AE: "→", 0xF0D7: "・"}
GLYPHS = {
    "alpha": {
        0xF0C6: "○", 0xF0C7: "△", 0xF0C8: "×", 0xF0C9: "―", 0xF06F: "□", 0xF0F0: " ⇒ ", 0xF0C0: "→ ", 0xF0C1: "→ ", 0xF0FB: "・", 0xF083: "[Ctrl]", 0xF084: "[Shift]",
        0xF08F: "[Enter]", 0xF081: "[Tab]", 0xF082: "[Alt]", 0xF085: "[Esc]", 0xF08C: "[Space]", 0xF086: "[Insert]", 0xF087: "[Delete]", 0xF088: "[Home]", 0xF0BC: "[↑]",
        0xF0BD: "[↓]", 0xF0BE: "[←]", 0xF0BF: "[→]", 0xF02C: "[,]", 0xF02E: "[.]", 0xF02F: "[/]", 0xF03D: "[=]", 0xF0FA: "・", 0xF06D: "μ", 0xF0A3: "≤", 0xF0A5: "∞",
        0xF0AB: "↔", 0xF0B1: "±", 0xF0B4: "×", 0xF0E2: "®", 0xF0E3: "©", 0xF0E4: "™", 0xF070: "▲", 0xF071: "▼",
    },
    "beta": {0xF06C: "●", 0xF06E: "■", 0xF075: "►", 0xF067: "→", 0xF0AC: "←", 0xF0AD: "↑", 0xF0AF: "↓", 0xF07C: "|"},
    "gamma": {},
}


def glyph_map(vendor: str) -> dict[str, str]:
    out = {chr(first + i): name for first, names in GLYPH_RUNS.get(vendor, ()) for i, name in enumerate(names)}
    out |= {chr(c): name for c, name in (GLYPHS_COMMON if vendor in GLYPHS else {}).items()}
    return out | {chr(c): name for c, name in GLYPHS.get(vendor, {}).items()}
