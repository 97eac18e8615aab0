"""``python -m ledgerline <command> [options]``

commands: daily-run (the six marts for one date), audit (access matrix from
listing responses), upkeep (compaction + snapshot/orphan reports).
"""

from __future__ import annotations

import sys


def main(argv=None):
    argv = list(sys.argv[1:] if argv is None else argv)
    commands = {"daily-run": "ledgerline.plans.daily_run", "audit": "ledgerline.plans.access",
                "upkeep": "ledgerline.plans.maintenance"}
    if not argv or argv[0] not in commands:
        print(__doc__.strip())
        return 2
    module = __import__(commands[argv[0]], fromlist=["main"])
    module.main(argv[1:])
    return 0


if __name__ == "__main__":
    sys.exit(main())
