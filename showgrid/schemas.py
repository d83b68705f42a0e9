"""Explicit schemas; nothing is inferred."""

SESSION = "struct<timestamp:string,location:string,url_tickets:string,url_info:string,version:string,special:string,url:string>"

SCRAPED_CSV = ("theater string, title string, theater_film_link string, dates string, director string, year string, "
               "special string, title_en string, film_url string")

CATALOG_JSON = (f"title string, director string, year int, short_url string, film_url string, rating double, "
                f"genres array<string>, dates array<{SESSION}>")

SHOWTIME_API = """
d struct<Cinemas:array<struct<Id:int,Dates:array<struct<FilterDate:string,Movies:array<struct<Key:string,Title:string,
Director:string,Formats:array<struct<Language:string,Showtimes:array<struct<CinemaId:int,Time:string,VistaCinemaId:string,
ShowtimeId:string>>>>>>>>>>>
"""

USER_EXPORT = {
    "watched": "`Date` string, `Name` string, `Year` string, uri string",
    "ratings": "`Date` string, `Name` string, `Year` string, uri string, `Rating` string",
    "watchlist": "`Date` string, `Name` string, `Year` string, uri string",
    "likes": "`Date` string, `Name` string, `Year` string, uri string",
    "diary": "`Date` string, `Name` string, `Year` string, uri string, `Rating` string, `Rewatch` string",
}

PAGES = "page_id long, url string, html string"
