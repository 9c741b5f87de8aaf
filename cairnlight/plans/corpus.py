"""A small knowledge project, for operators whose structure the tables lack: documents, code rows and logs.

The same rows reach Spark as a DataFrame and an SQL oracle as VALUES.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_WEAPON = """---
module: game/Anvil
---
# Anvil

The anvil holds every blade while the `Smith` works; see `Anvil::Strike` and HammerDriver.

## Context

Part of the forge. It is reached through `ForgeDoor` and through the yard.

## Data Flow

```
# not a heading
iron -> anvil -> blade
```

## Key Claims

- [extracted] `Anvil` defined at `src/anvil.h`
- [Inferred] Blades cool
  on the anvil between strikes.
* It breaks when cold.
-
- `Tongs` defined at `src/old/tongs.h:12`

## Boundaries

- Does not sharpen blades, `Whetstone` does.

## Edge Cases

### Cold iron

Cold iron chips.

## Evidence

- `Anvil` defined at `src/anvil.h:3`
- `Strike` defined at `src/anvil.cpp`
- `Missing_Thing` defined at `src/none.h`
"""

_FORGE = """---
domain: forge
applies-when: [Winter, "cold-iron"]
---

## Architecture

The forge joins `Anvil`, `Bellows` and the yard in one loop of heat and work.

## Empty

## Risk

This module is hot.

#tag is no heading
  ## Indented
text under it that is long enough to stand on its own feet
"""

_LESSON = """---
lesson: cracked-blade
module: game/Anvil
applies-when: winter, night
excludes: [summer, "Bad Slug"]
guard-strength: Strict
---
# Cracked blade

## Symptom

The blade cracks with a loud sound: error E42 in `Anvil::Strike`.

## Root Cause

The iron was cold, so `Strike` hit too early.

## Fix

Heat it first.

## Guard

Check the colour of the iron before each strike, always.
"""

_BARE = """Just text with no heading at all, and nothing that says what it is.

~~~
## fenced
~~~
"""

_FEATURE = """---
feature: quench
---
# Quench

## Prefix notes

Nothing here is a fix; because of that the kind stays plain.

## Claims about water

Prose before any bullet.
- That is wet.
- WaterTub cools at least three blades an hour.

## Evidence

- see the yard
- `WaterTub` defined at `src/tub.rs`
"""

_PACK = """---
domain: metal
---
# Metal

## Key Claims

- `Bellows` defined at `src/bellows.py`
- They blow.
"""

DOCUMENTS = [
    (0, "modules/Anvil.md", _WEAPON),
    (0, "domains/forge.md", _FORGE),
    (0, "lessons/cracked.md", _LESSON),
    (0, "notes/bare.md", _BARE),
    (0, "features/quench.md", _FEATURE),
    (1, "domains/metal.md", _PACK),
    (1, "Architecture.md", "---\narchitecture: smithy\n---\n# Smithy\n\n## Context\n\nEverything that glows, from the forge to the shop in front of it.\n"),
]

FILES = [
    ("src/anvil.h", "cpp", "class Anvil\n{\n  int heat;\n};\n"),
    ("src/anvil.cpp", "cpp", '#include "src/anvil.h"\nvoid Anvil::Strike(int force)\n{\n  Cool(force);\n  Ring();\n}\n'),
    ("src/tongs.h", "cpp", "struct Tongs : public Tool\n{\n};\n"),
    ("src/bellows.py", "python", "import os\n\nclass Bellows(Tool):\n    def blow(self):\n        return self.press(os.getcwd())\n\n    def press(self, where):\n        return where\n"),
    ("src/tub.rs", "rust", "use std::fmt;\npub struct WaterTub {}\npub fn cool(b: i32) -> i32 {\n    drip(b)\n}\nfn drip(b: i32) -> i32 { b }\n"),
    ("src/yard.ts", "typescript", "import { cool } from './tub';\nexport class Yard extends Place {}\nexport function sweep() {\n  clear();\n}\nfunction clear() {}\n"),
]

SYMBOLS = [
    ("Anvil", "Anvil", "class", "cpp", "src/anvil.h", 1, "definition"),
    ("Anvil", "Anvil", "class", "cpp", "src/forward.h", 9, "declaration"),
    ("heat", "Anvil::heat", "field", "cpp", "src/anvil.h", 3, "definition"),
    ("Strike", "Anvil::Strike", "function", "cpp", "src/anvil.cpp", 2, "definition"),
    ("Strike", "Anvil::Strike", "function", "cpp", "src/anvil.h", 4, "declaration"),
    ("Cool", "Anvil::Cool", "function", "cpp", "src/cool.cpp", 5, "definition"),
    ("Ring", "Ring", "function", "cpp", "src/bell.cpp", 1, "definition"),
    ("Ring", "Ring", "function", "cpp", "src/chain.cpp", 7, "definition"),
    ("Tongs", "Tongs", "struct", "cpp", "src/tongs.h", 1, "definition"),
    ("Tool", "Tool", "class", "cpp", "src/tool.h", 1, "definition"),
    ("Bellows", "Bellows", "class", "python", "src/bellows.py", 3, "definition"),
    ("blow", "Bellows::blow", "function", "python", "src/bellows.py", 4, "definition"),
    ("press", "Bellows::press", "function", "python", "src/bellows.py", 7, "definition"),
    ("WaterTub", "WaterTub", "struct", "rust", "src/tub.rs", 2, "definition"),
    ("cool", "cool", "function", "rust", "src/tub.rs", 3, "definition"),
    ("drip", "drip", "function", "rust", "src/tub.rs", 6, "definition"),
    ("HammerDriver", "HammerDriver", "class", "cpp", "src/hammer.h", 2, "definition"),
]

EDGES = [
    (1, "src/anvil.cpp", "", "src/anvil.h", "include", 1),
    (2, "src/anvil.cpp", "Strike", "Cool", "call", 4),
    (3, "src/anvil.cpp", "Strike", "Ring", "call", 5),
    (4, "src/anvil.cpp", "Strike", "heat", "writes", 6),
    (5, "src/anvil.cpp", "Strike", "heat", "writes", 6),
    (6, "src/tongs.h", "Tongs", "Tool", "inherits", 1),
    (7, "src/tongs.h", "Tongs", "Tool", "inherits", 9),
    (8, "src/bellows.py", "Bellows", "Tool", "inherits", 3),
    (9, "src/bellows.py", "blow", "press", "call", 5),
    (10, "src/bellows.py", "", "os", "import", 1),
    (11, "src/tub.rs", "cool", "drip", "call", 4),
    (12, "src/forge.cpp", "Heat", "Strike", "call", 8),
    (13, "src/forge.cpp", "Heat", "Anvil", "uses_type", 2),
    (14, "src/forge.cpp", "", "anvil.h", "include", 1),
]

PATHS = [("src/anvil.h", "cpp"), ("src/anvil.cpp", "cpp"), ("src/tongs.h", "cpp"), ("src/bellows.py", "python"), ("src/tub.rs", "rust"), ("src/forge.cpp", "cpp")]

TEMPLATES = [(1, "run ${HOME_DIR}/bin --key ${API_KEY} ${HOME_DIR}"), (2, "plain"), (3, "${NOPE} and $SHELL")]
VARIABLES = [("HOME_DIR", "/home/smith"), ("API_KEY", "k-1")]

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "kdocs": ("library int, relative string, content string", DOCUMENTS),
    "kfiles": ("path string, language string, content string", FILES),
    "ksymbols": ("name string, qualified_name string, kind string, language string, file string, line int, role string", SYMBOLS),
    "kedges": ("id bigint, source_file string, source_symbol string, target_symbol string, relation string, line int", EDGES),
    "kpaths": ("path string, language string", PATHS),
    "ktemplates": ("id int, text string", TEMPLATES),
    "kvariables": ("name string, value string", VARIABLES),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _literal(value: object, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {'VARCHAR' if kind == 'string' else kind})"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"CAST({value} AS {kind.upper()})"


def values(name: str) -> str:
    """``name AS (VALUES ...)`` for a WITH clause."""
    schema, rows = TABLES[name]
    columns = [c.split() for c in schema.split(", ")]
    body = ", ".join("(" + ", ".join(_literal(v, c[1]) for v, c in zip(r, columns, strict=True)) + ")" for r in rows)
    return f"{name}({', '.join(c[0] for c in columns)}) AS (VALUES {body})"
