import sys

from lodeseek.cli import main

sys.exit(main())
