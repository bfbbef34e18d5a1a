import sys

from palisade.command import main

sys.exit(main(sys.argv[1:]))
