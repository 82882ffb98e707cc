"""``python -m planweave``"""

from .cli import main

raise SystemExit(main())
