import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tallyroom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, partitions=4, memory="4g")


@pytest.fixture(scope="session")
def grid(spark):
    """Cells from lists of rows; a row is None (absent) or a list of values, None for an absent cell."""
    schema = ("workbook_id string, sheet_idx int, row_idx int, col_idx int, cell_type string, "
              "str string, num double, bool boolean, fmt string")

    def build(*books):
        out = []
        for b, rows in enumerate(books):
            for r, row in enumerate(rows):
                for c, v in enumerate(row or []):
                    if v is None:
                        continue
                    value, fmt = v if isinstance(v, tuple) else (v, "General")
                    kind = ("boolean" if isinstance(value, bool) else "numeric" if isinstance(value, (int, float))
                            else "blank" if value == "" else "string")
                    out.append((f"w{b}", 0, r, c, kind, value if kind == "string" else None,
                                float(value) if kind == "numeric" else None, value if kind == "boolean" else None, fmt))
        return spark.createDataFrame(out, schema)
    return build
