"""Column-to-Column building blocks; no function here touches a DataFrame."""
