"""Pure ``Column -> Column`` functions; Catalyst plans all of them."""
