import sys

from porelight.cli import main

sys.exit(main())
