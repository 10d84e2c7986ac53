import sys

from chainloom.cli import main

sys.exit(main())
