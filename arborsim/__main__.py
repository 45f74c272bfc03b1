import sys

from arborsim.plans.engine import main

sys.exit(main())
