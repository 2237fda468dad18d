"""Pages of tokens: rows, fields and tables. A page is a group of bounded size, so grouped Arrow functions suit it."""
