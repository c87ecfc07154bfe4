"""Time the SQL twins alone: python tools/duck.py SF [name-prefix ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle import statements  # noqa: E402
from tools.check import duck  # noqa: E402

con = duck(f"/root/testdata/sf{sys.argv[1]}")
for name, sql in statements.build().items():
    if any(name.startswith(p) for p in sys.argv[2:]):
        t = time.time()
        try:
            n = len(con.execute(sql).fetchall())
        except Exception as exc:
            n = str(exc)[:600]
        print(name, n, f"{time.time() - t:.2f}s", flush=True)
