"""No streaming operators.

Every input of this domain is a finished file (one per scenario and model
year), so all plans are batch plans.  The package exists so that the layout is
uniform; nothing is registered here.
"""
