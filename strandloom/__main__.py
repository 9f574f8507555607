import sys

from strandloom.plans.commands import main

print(main(sys.argv[1:]))
