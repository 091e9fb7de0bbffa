import sys

from streamspec.cli import main

sys.exit(main())
