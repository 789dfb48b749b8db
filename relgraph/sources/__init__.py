"""Reading rosters, people, pages and names; writing tables, text and graphs."""
